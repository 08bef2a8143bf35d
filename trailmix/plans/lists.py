"""Text examples, and lists that come from a text generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draw
from ..operators import generated, logs, sequences
from ..sources import tables
from .inputs import log, stored_rows, stored_split, stored_train
from .registry import longs, part, query, rounded

BEAMS = 12


@query("instruction_examples", """
SELECT user_id, CAST(pos AS BIGINT) AS pos, instruction, input, output FROM ex_txt""")
def instruction_examples(spark, d):
    return longs(sequences.instruction_examples(sequences.sliding_examples(stored_train(spark, d))), "pos")


@query("chat_messages", f"""
SELECT user_id, CAST(pos AS BIGINT) AS pos, 0::BIGINT AS turn, 'system' AS role, '{sequences.SYSTEM_PROMPT}' AS content FROM ex_txt
UNION ALL SELECT user_id, CAST(pos AS BIGINT), 1, 'user', instruction || chr(10) || chr(10) || input FROM ex_txt
UNION ALL SELECT user_id, CAST(pos AS BIGINT), 2, 'assistant', output FROM ex_txt""")
def chat_messages(spark, d):
    examples = sequences.instruction_examples(sequences.sliding_examples(stored_train(spark, d)))
    turns = sequences.chat_messages(examples).select("user_id", "pos", F.posexplode("messages").alias("turn", "m"))
    return longs(turns.select("user_id", "pos", "turn", "m.role", "m.content"), "pos", "turn")


@query("leakage_check", """
SELECT CAST(count(*) AS BIGINT) AS leaks FROM ex_txt e JOIN te USING (user_id)
WHERE lower(e.output) = lower(te.name) AND e.output NOT IN (SELECT name FROM tr WHERE tr.user_id = e.user_id)""")
def leakage_check(spark, d):
    fit, test = stored_split(spark, d)
    examples = sequences.instruction_examples(sequences.sliding_examples(fit))
    return sequences.leakage_check(examples, test, fit)


@query("catalog", "SELECT item_id, name, norm_name FROM cat_first")
def catalog(spark, d):
    return logs.catalog(log(spark, d))


@query("chains", """
SELECT norm_name, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items FROM cat_first GROUP BY norm_name HAVING count(DISTINCT item_id) > 1""")
def chains(spark, d):
    return logs.chains(logs.catalog(log(spark, d)))


# Stand-in for a generator's beams: drawn part names in varying spelling, some unknown or blank.
part("beams", f"""
SELECT user_id, pos, CASE pos % 4 WHEN 0 THEN upper(name) WHEN 1 THEN '  ' || replace(name, ' ', '   ')
  WHEN 2 THEN CASE WHEN dr % 5 = 0 THEN '' ELSE name END ELSE CASE WHEN dr % 3 = 0 THEN name || ' x' ELSE name END END AS text
FROM (SELECT u.user_id, t.pos, ('0x' || substr(md5(concat_ws('|', u.user_id, t.pos)), 1, 8))::BIGINT AS dr
      FROM (SELECT DISTINCT user_id FROM tr) u, range(1, {BEAMS + 1}) t(pos)) b
JOIN items_raw p ON p.item_id = b.dr % (SELECT count(*) FROM part)""")
part("beam_nm", r"SELECT user_id, pos, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS name FROM beams")
part("raw_lists", """
SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank FROM (
  SELECT user_id, name, min(pos) AS pos FROM beam_nm WHERE name <> '' GROUP BY user_id, name)""")
part("hist_nm", "SELECT DISTINCT user_id, lower(name) AS name FROM tr")
part("gen_lists", """
SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM raw_lists
WHERE (user_id, name) NOT IN (SELECT user_id, name FROM hist_nm)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= 10""")


def beams(spark, d, fit):
    items = tables.parts(spark, d).select("item_id", "name")
    pos = F.explode(F.sequence(F.lit(1), F.lit(BEAMS)))
    drawn = (fit.select("user_id").distinct().select("user_id", pos.alias("pos"))
             .withColumn("dr", draw(F.col("user_id"), F.col("pos")))
             .withColumn("item_id", F.col("dr") % items.agg(F.count("*")).scalar()).join(items, "item_id"))
    name = F.col("name")
    text = (F.when(F.col("pos") % 4 == 0, F.upper(name))
            .when(F.col("pos") % 4 == 1, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("   "))))
            .when(F.col("pos") % 4 == 2, F.when(F.col("dr") % 5 == 0, F.lit("")).otherwise(name))
            .otherwise(F.when(F.col("dr") % 3 == 0, F.concat(name, F.lit(" x"))).otherwise(name)))
    return drawn.select("user_id", "pos", text.alias("text"))


@query("generated_list_cleanup", """
SELECT 'recs' AS kind, user_id, CAST(rank AS INTEGER) AS rank, name FROM gen_lists
UNION ALL SELECT 'recs_raw' AS kind, user_id, CAST(rank AS INTEGER) AS rank, name FROM raw_lists""")
def generated_list_cleanup(spark, d):
    fit = stored_train(spark, d)
    raw = beams(spark, d, fit)
    kept = generated.clean_lists(raw, generated.history_names(fit)).withColumn("kind", F.lit("recs"))
    every = generated.distinct_beams(raw).withColumn("kind", F.lit("recs_raw"))
    return kept.unionByName(every).select("kind", "user_id", "rank", "name")


@query("in_catalog", """
SELECT user_id, CAST(rank AS INTEGER) AS rank, name, name IN (SELECT norm_name FROM cat_first) AS in_catalog FROM raw_lists""")
def in_catalog(spark, d):
    rows, fit, _ = stored_rows(spark, d)
    lists = generated.distinct_beams(beams(spark, d, fit))
    return generated.in_catalog(lists, logs.catalog(rows)).select("user_id", "rank", "name", "in_catalog")


@query("catalog_restrict", """
SELECT user_id, CAST(rank AS INTEGER) AS rank, name FROM raw_lists WHERE name IN (SELECT norm_name FROM cat_first)""")
def catalog_restrict(spark, d):
    rows, fit, _ = stored_rows(spark, d)
    lists = generated.distinct_beams(beams(spark, d, fit))
    return generated.catalog_restrict(lists, logs.catalog(rows)).select("user_id", "rank", "name")


@query("exclude_seen_candidates", """
SELECT user_id, CAST((SELECT count(DISTINCT norm_name) FROM cat_first) - count(*) AS BIGINT) AS n_candidates,
  CAST((SELECT count(*) FROM raw_lists r WHERE r.user_id = h.user_id AND r.name IN (SELECT norm_name FROM cat_first)
    AND r.name NOT IN (SELECT name FROM hist_nm x WHERE x.user_id = r.user_id)) AS BIGINT) AS n_allowed
FROM hist_nm h GROUP BY user_id""")
def exclude_seen_candidates(spark, d):
    rows, fit, _ = stored_rows(spark, d)
    history, items = generated.history_names(fit), logs.catalog(rows)
    proposals = generated.distinct_beams(beams(spark, d, fit))
    allowed = (generated.allowed_candidates(proposals, history, items).groupBy("user_id")
               .agg(F.count("*").alias("n_allowed")))
    counts = generated.candidate_counts(history, items).select("user_id", "n_candidates")
    return (counts.join(allowed, "user_id", "left")
            .select("user_id", "n_candidates", F.coalesce("n_allowed", F.lit(0)).cast("bigint").alias("n_allowed")))


@query("generation_diagnostics", """
WITH len AS (SELECT user_id, count(g.name) AS n FROM (SELECT DISTINCT user_id FROM tr) u LEFT JOIN gen_lists g USING (user_id) GROUP BY user_id)
SELECT CAST(count(*) AS BIGINT) AS n_lists, CAST(count(*) FILTER (n >= 10) AS BIGINT) AS full_lists, round(avg(n), 6) AS mean_length,
  round((SELECT count(*) FROM raw_lists WHERE name IN (SELECT norm_name FROM cat_first)) / (SELECT count(*) FROM raw_lists), 6) AS in_catalog_share,
  round(1 - sum(n) / (SELECT count(*) FROM raw_lists), 6) AS dropped_share FROM len""")
def generation_diagnostics(spark, d):
    rows, fit, _ = stored_rows(spark, d)
    raw = beams(spark, d, fit)
    out = generated.generation_diagnostics(
        generated.distinct_beams(raw), generated.clean_lists(raw, generated.history_names(fit)),
        fit, logs.catalog(rows))
    return rounded(out, "mean_length", "in_catalog_share", "dropped_share")
