"""Log preparation: sources, projections, joins, aggregates, windows, cuts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as tf
from ..operators import generated, logs, sequences, spread, toplists
from ..sources import store, tables
from .inputs import log, stored_rows, stored_split, stored_train
from .registry import longs, part, query, rounded

EPOCH = "CAST(epoch(ts) AS BIGINT)"


def with_epoch(df):
    return df.withColumn("ts", tf.epoch_seconds(F.col("ts")))


# ---- sources and sinks -------------------------------------------------------------

@query("interactions", f"SELECT user_id, item_id, name, rating, {EPOCH} AS ts FROM inter")
def interactions(spark, d):
    return with_epoch(tables.purchases(spark, d).drop("seq"))


@query("item_attributes", """
SELECT i.item_id, r.name, r.categories, r.city, r.lat, r.lon, r.is_open
FROM (SELECT DISTINCT item_id FROM tr) i LEFT JOIN items_raw r USING (item_id)""")
def item_attributes(spark, d):
    items = logs.distinct_values(stored_train(spark, d), "item_id")
    return logs.item_attributes(tables.parts(spark, d), items)


@query("splits_io", f"""
SELECT user_id, item_id, name, rating, {EPOCH} AS ts, rn = 1 AS held_out FROM coh_rn""")
def splits_io(spark, d):
    path = store.scratch_path(spark, "split")
    store.write_split(*stored_split(spark, d), path)
    fit, test = store.read_split(spark, path)
    rows = (fit.withColumn("held_out", F.lit(False))
            .unionByName(test.withColumn("held_out", F.lit(True))))
    return with_epoch(rows.drop("seq"))


@query("catalog_io", "SELECT CAST(item_id AS VARCHAR) AS item_id, name, norm_name FROM cat_first")
def catalog_io(spark, d):
    path = store.scratch_path(spark, "catalog")
    store.write_catalog(logs.catalog(log(spark, d)), path)
    return store.read_catalog(spark, path)


@query("histories_io", """
SELECT user_id, CAST(pos AS BIGINT) AS pos, name FROM seqs
UNION ALL SELECT user_id, CAST(0 AS BIGINT) AS pos, name FROM te""")
def histories_io(spark, d):
    path = store.scratch_path(spark, "histories")
    fit, test = stored_split(spark, d)
    store.write_histories(logs.ordered_history(fit), test, path)
    history, held = store.read_histories(spark, path)
    return longs(history.unionByName(held.withColumn("pos", F.lit(0))), "pos")


part("ex_rows", """
SELECT user_id, pos, list(name) OVER w AS ctx, name AS target FROM seqs
WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)""")
part("ex_txt", f"""
SELECT user_id, pos, '{sequences.INSTRUCTION}' AS instruction,
  '{sequences.INPUT_PREFIX}' || array_to_string(ctx, ', ') AS input, target AS output
FROM ex_rows WHERE pos > 3""")


@query("examples_io", """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(pos AS BIGINT) AS pos, instruction, input, output FROM ex_txt""")
def examples_io(spark, d):
    path = store.scratch_path(spark, "examples")
    windows = sequences.sliding_examples(stored_train(spark, d))
    store.write_examples(sequences.instruction_examples(windows), path)
    return store.read_examples(spark, path)


# ---- projections and scalar functions ----------------------------------------------

# Fixed value: the characters of the whitespace class, as RE2 writes them.
RE2_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
DISPLAY = rf"trim(regexp_replace(coalesce(text, 'nan'), '{RE2_SPACE}', ' ', 'g'))"


@query("display_name", f"SELECT doc_id, {DISPLAY} AS display FROM documents")
def display_name(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", tf.display_name(F.col("text")).alias("display"))


@query("norm_name", f"SELECT doc_id, lower({DISPLAY}) AS norm FROM documents")
def norm_name(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", tf.norm_name(F.col("text")).alias("norm"))


@query("parse_date", """
SELECT o_orderkey, CAST(epoch(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS BIGINT) AS epoch_s
FROM orders""")
def parse_date(spark, d):
    text = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    return tables.table(spark, d, "orders").select(
        "o_orderkey", tf.epoch_seconds(tf.parse_date(text)).alias("epoch_s"))


@query("count_bucket", """
SELECT user_id, n_rows, CAST(least(length(bin(n_rows)), 11) AS INTEGER) AS bucket
FROM (SELECT user_id, count(*) AS n_rows FROM inter GROUP BY user_id)""")
def count_bucket(spark, d):
    return logs.user_counts(tables.purchases(spark, d)).withColumn("bucket", tf.count_bucket(F.col("n_rows")))


part("tr_mean", "SELECT avg(rating) AS mu FROM tr")
part("fit_mean", "SELECT avg(rating) AS mu FROM fit")


@query("star_bucket", """
SELECT item_id, CAST(greatest(1, least(11, round_even(2 * coalesce(m, (SELECT mu FROM tr_mean)), 0) - 1)) AS INTEGER) AS bucket
FROM (SELECT p_partkey AS item_id FROM part) LEFT JOIN (SELECT item_id, avg(rating) AS m FROM trd GROUP BY item_id) USING (item_id)""")
def star_bucket(spark, d):
    fit = stored_train(spark, d)
    items = tables.parts(spark, d).select("item_id").join(logs.item_stats(fit), "item_id", "left")
    return items.select("item_id", tf.star_bucket(F.col("mean_rating"), logs.global_mean(fit).scalar()).alias("bucket"))


part("tok_rows", """
SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS token FROM part""")
# CRC-32 spelled out, as DuckDB has no function for it.
part("tok_buckets", """
SELECT token, CAST(xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(token, ''), lambda c: ord(c)::UBIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)::UBIGINT[]),
      lambda crc, step: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END)),
  4294967295::UBIGINT) % 8192 AS BIGINT) AS bucket FROM (SELECT DISTINCT token FROM tok_rows)""")


@query("name_tokens", "SELECT item_id, token, bucket FROM tok_rows JOIN tok_buckets USING (token)")
def name_tokens(spark, d):
    name = F.col("name")
    pairs = F.arrays_zip(tf.name_tokens(name).alias("token"), tf.hash_tokens(name).alias("bucket"))
    return (tables.parts(spark, d).select("item_id", F.explode(pairs).alias("p"))
            .select("item_id", "p.token", "p.bucket"))


@query("clip_prediction", """
SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(5.0, round(l_extendedprice / 10000 - 1, 6))) AS clipped
FROM lineitem""")
def clip_prediction(spark, d):
    line = tables.table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey",
                       tf.clip(F.round(F.col("l_extendedprice") / 10000 - 1, 6)).alias("clipped"))


@query("dense_index", """
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT name FROM inter)""")
def dense_index(spark, d):
    return longs(logs.dense_index(tables.purchases(spark, d), "name"), "idx")


@query("below_threshold_filters", """
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS n_rows FROM inter
WHERE rating >= 3.5 AND user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) >= 20)
GROUP BY user_id, item_id""")
def below_threshold_filters(spark, d):
    return (log(spark, d).where(F.col("rating") >= 3.5)
            .groupBy("user_id", "item_id").agg(F.count("*").alias("n_rows")))


# ---- joins -------------------------------------------------------------------------

@query("cohort_filter", f"SELECT user_id, item_id, name, rating, {EPOCH} AS ts FROM coh")
def cohort_filter(spark, d):
    return with_epoch(log(spark, d).drop("seq"))


@query("split_anti", f"SELECT user_id, item_id, name, rating, {EPOCH} AS ts FROM tr")
def split_anti(spark, d):
    return with_epoch(stored_train(spark, d).drop("seq"))


@query("item_name_lookup", "SELECT user_id, item_id, n.name FROM seen_pairs JOIN item_nm n USING (item_id)")
def item_name_lookup(spark, d):
    fit = stored_train(spark, d)
    return fit.select("user_id", "item_id").distinct().join(logs.item_names(fit), "item_id")


@query("seen_mask", """
SELECT user_id, item_id FROM (SELECT DISTINCT user_id, item_id FROM coh)
EXCEPT SELECT user_id, item_id FROM tr""")
def seen_mask(spark, d):
    rows, fit, _ = stored_rows(spark, d)
    return toplists.mask_seen(rows.select("user_id", "item_id").distinct(), fit)


@query("seen_name_mask", """
SELECT user_id, lower(name) AS name FROM te
EXCEPT SELECT user_id, lower(name) FROM tr""")
def seen_name_mask(spark, d):
    fit, test = stored_split(spark, d)
    held = test.select("user_id", tf.norm_name(F.col("name")).alias("name"))
    return toplists.mask_seen_names(held, generated.history_names(fit))


@query("known_pairs", """
WITH u AS MATERIALIZED (SELECT DISTINCT user_id FROM tr), i AS MATERIALIZED (SELECT DISTINCT item_id FROM tr)
SELECT te.user_id, te.item_id, te.rating FROM te JOIN u ON te.user_id = u.user_id JOIN i ON te.item_id = i.item_id""")
def known_pairs(spark, d):
    fit, test = stored_split(spark, d)
    return logs.known_pairs(test, fit).select("user_id", "item_id", "rating")


@query("cold_targets", """
SELECT CAST(count(*) AS BIGINT) AS n_test, CAST(count(*) FILTER (cold) AS BIGINT) AS n_cold,
  round(avg(cold::INT), 6) AS cold_share, round(1 - avg(cold::INT), 6) AS hit_ceiling
FROM (SELECT lower(name) NOT IN (SELECT lower(name) FROM tr) AS cold FROM te)""")
def cold_targets(spark, d):
    fit, test = stored_split(spark, d)
    return rounded(logs.cold_targets(test, fit), "cold_share", "hit_ceiling")


@query("attribute_align", """
SELECT i.item_id, p.city, p.lat FROM (SELECT DISTINCT item_id FROM click_rows) i
LEFT JOIN items_raw p USING (item_id)""")
def attribute_align(spark, d):
    attrs = tables.parts(spark, d).select("item_id", "city", "lat")
    return logs.align(logs.distinct_values(tables.clicks(spark, d), "item_id"), attrs)


# ---- aggregates --------------------------------------------------------------------

@query("user_counts", "SELECT user_id, CAST(count(*) AS BIGINT) AS n_rows FROM inter GROUP BY user_id")
def user_counts(spark, d):
    return logs.user_counts(tables.purchases(spark, d))


@query("dataset_summary", """
SELECT CAST((SELECT count(DISTINCT user_id) FROM coh) AS BIGINT) AS users,
  CAST((SELECT count(*) FROM coh) AS BIGINT) AS interactions,
  CAST((SELECT count(DISTINCT item_id) FROM coh) AS BIGINT) AS items,
  CAST((SELECT count(DISTINCT lower(name)) FROM coh) AS BIGINT) AS names,
  CAST((SELECT count(*) FROM tr) AS BIGINT) AS train_rows, CAST((SELECT count(*) FROM te) AS BIGINT) AS test_rows,
  CAST(count(*) AS BIGINT) AS examples, round(avg(length(input)), 6) AS input_len_mean,
  CAST(max(length(input)) AS BIGINT) AS input_len_max FROM ex_txt""")
def dataset_summary(spark, d):
    rows, fit, test = stored_rows(spark, d)
    examples = sequences.instruction_examples(sequences.sliding_examples(fit))
    out = logs.dataset_summary(rows, fit, test, examples)
    return longs(rounded(out, "input_len_mean"), "input_len_max")


@query("item_stats", """
SELECT 'item' AS side, item_id AS id, CAST(count(*) AS BIGINT) AS n, round(avg(rating), 6) AS mean_rating FROM trd GROUP BY item_id
UNION ALL
SELECT 'user' AS side, user_id AS id, CAST(count(*) AS BIGINT) AS n, round(avg(rating), 6) AS mean_rating FROM trd GROUP BY user_id""")
def item_stats(spark, d):
    fit = stored_train(spark, d)
    items = logs.item_stats(fit).select(F.lit("item").alias("side"), F.col("item_id").alias("id"),
                                        F.col("n_raters").alias("n"), "mean_rating")
    users = logs.user_stats(fit).select(F.lit("user").alias("side"), F.col("user_id").alias("id"),
                                        F.col("n_items").alias("n"), "mean_rating")
    return rounded(items.unionByName(users), "mean_rating")


@query("global_mean", "SELECT round(mu, 6) AS mu FROM tr_mean")
def global_mean(spark, d):
    return rounded(logs.global_mean(stored_train(spark, d)), "mu")


@query("ordered_history", "SELECT user_id, CAST(pos AS BIGINT) AS pos, item_id, name FROM seqs")
def ordered_history(spark, d):
    return longs(logs.ordered_history(stored_train(spark, d)).select("user_id", "pos", "item_id", "name"), "pos")


@query("l1_normalize", """
SELECT user_id, item_id, round(rating / sum(rating) OVER (PARTITION BY user_id), 6) AS weight FROM trd""")
def l1_normalize(spark, d):
    pairs = toplists.rated_pairs(stored_train(spark, d))
    out = logs.l1_normalize(pairs, ["user_id"], "rating", "weight")
    return rounded(out.select("user_id", "item_id", "weight"), "weight")


@query("l2_normalize", """
SELECT vec_id AS item_id, CAST(i AS BIGINT) AS dim, round(v[i + 1] / greatest(sqrt(list_inner_product(v, v)), 1e-12), 5) AS x
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), range(64) t(i)""")
def l2_normalize(spark, d):
    unit = tables.embeddings(spark, d).select("item_id", F.posexplode(tf.l2_normalize(F.col("vec"))).alias("dim", "x"))
    return rounded(longs(unit, "dim"), "x", digits=5)


@query("dedupe_pairs_last", f"SELECT user_id, item_id, name, rating, {EPOCH} AS ts FROM trd")
def dedupe_pairs_last(spark, d):
    return with_epoch(logs.dedupe_last(stored_train(spark, d)).drop("seq"))


@query("dedupe_first", f"""
SELECT user_id, item_id, rating, {EPOCH} AS ts FROM coh
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq) = 1""")
def dedupe_first(spark, d):
    return with_epoch(logs.dedupe_first(log(spark, d)).select("user_id", "item_id", "rating", "ts"))


# ---- windows -----------------------------------------------------------------------

@query("leave_one_out", f"SELECT user_id, item_id, name, rating, {EPOCH} AS ts FROM te")
def leave_one_out(spark, d):
    return with_epoch(stored_split(spark, d)[1].drop("seq"))


@query("validation_split", f"""
SELECT user_id, item_id, rating, {EPOCH} AS ts, rn = 1 AS held_out FROM trd_rn""")
def validation_split(spark, d):
    fit, valid = logs.validation_split(stored_train(spark, d))
    rows = (fit.withColumn("held_out", F.lit(False))
            .unionByName(valid.withColumn("held_out", F.lit(True))))
    return with_epoch(rows.drop("seq", "name"))


@query("sliding_examples", """
SELECT user_id, CAST(pos AS BIGINT) AS pos, CAST(len(ctx) AS INTEGER) AS ctx_len, array_to_string(ctx, '|') AS ctx, target
FROM ex_rows WHERE pos > 3""")
def sliding_examples(spark, d):
    rows = sequences.sliding_examples(stored_train(spark, d))
    return longs(rows.select("user_id", "pos", F.size("context").alias("ctx_len"),
                             F.array_join("context", "|").alias("ctx"), "target"), "pos")


part("pairs_qi", """
SELECT user_id, pos, q, i FROM (
  SELECT user_id, row_number() OVER w AS pos, lag(item_id) OVER w AS q, item_id AS i FROM trd
  WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE q <> i""")


@query("consecutive_pairs", "SELECT user_id, CAST(pos AS BIGINT) AS pos, q, i FROM pairs_qi")
def consecutive_pairs(spark, d):
    return longs(sequences.consecutive_pairs(stored_train(spark, d)), "pos")


part("recent20", """
SELECT user_id, item_id, name, rn AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM tr) WHERE rn <= 20""")


@query("recent_items", """
SELECT user_id, item_id, CAST(rn AS INTEGER) AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM trd) WHERE rn <= 20""")
def recent_items(spark, d):
    return sequences.recent_items(stored_train(spark, d))


@query("recent_context", """
SELECT user_id, string_agg(name, '|' ORDER BY recency DESC) AS ctx FROM recent20 WHERE recency <= 15 GROUP BY user_id""")
def recent_context(spark, d):
    rows = sequences.recent_context(stored_train(spark, d))
    return rows.select("user_id", F.array_join("context", "|").alias("ctx"))


@query("topk_neighbors_per_group", """
SELECT item_id, user_id, rating, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rating DESC, user_id) AS rn FROM trd) WHERE rn <= 40""")
def topk_neighbors_per_group(spark, d):
    pairs = toplists.rated_pairs(stored_train(spark, d))
    order = [F.col("rating").desc(), F.col("user_id").asc()]
    return spread.first_per_group(pairs, ["item_id"], order, 40, rank="rank").select(
        "item_id", "user_id", "rating", "rank")


@query("gap_days", """
WITH l AS (SELECT user_id, max(ts) FILTER (rn = 1) AS last_ts, max(ts) FILTER (rn = 2) AS prev_ts FROM trd_rn WHERE rn <= 2 GROUP BY user_id)
SELECT CAST(median(date_diff('day', prev_ts, last_ts)) AS DOUBLE) AS validation_gap_days,
  CAST(median(date_diff('day', last_ts, te.ts)) AS DOUBLE) AS test_gap_days FROM l LEFT JOIN te USING (user_id)""")
def gap_days(spark, d):
    fit, test = stored_split(spark, d)
    return sequences.gap_days(fit, test)


# ---- order, sampling ---------------------------------------------------------------

@query("stable_sort", f"""
SELECT CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS place, user_id, item_id, rating, {EPOCH} AS ts FROM inter""")
def stable_sort(spark, d):
    rows = tables.purchases(spark, d)
    out = spread.global_index(rows, [F.col("ts"), F.col("seq")], "place")
    return longs(with_epoch(out.select("place", "user_id", "item_id", "rating", "ts")), "place")


@query("sample_examples", """
SELECT user_id, CAST(pos AS BIGINT) AS pos, output FROM ex_txt ORDER BY md5(concat_ws('|', user_id, pos, 42)) LIMIT 3000""")
def sample_examples(spark, d):
    examples = sequences.instruction_examples(sequences.sliding_examples(stored_train(spark, d)))
    picked = logs.sample_rows(examples.select("user_id", "pos", "output"), ["user_id", "pos"], 3000)
    return longs(picked, "pos")


@query("random_split", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS pos FROM coh)
SELECT user_id, CAST(pos AS BIGINT) AS pos, item_id,
  row_number() OVER (ORDER BY md5(concat_ws('|', user_id, pos, 42))) <= (SELECT round_even(0.2 * count(*), 0) FROM coh) AS is_test FROM n""")
def random_split(spark, d):
    rows = spread.positions(log(spark, d).select("user_id", "item_id", "ts", "seq"), ["user_id"], ["ts", "seq"])
    out = logs.random_split(rows.select("user_id", "pos", "item_id"), ["user_id", "pos"])
    return longs(out, "pos")


# ---- sets --------------------------------------------------------------------------

@query("distinct_values", """
SELECT 'user' AS side, CAST(user_id AS VARCHAR) AS value FROM inter GROUP BY user_id
UNION ALL SELECT 'item', CAST(item_id AS VARCHAR) FROM inter GROUP BY item_id
UNION ALL SELECT 'name', lower(name) FROM inter GROUP BY lower(name)""")
def distinct_values(spark, d):
    rows = tables.purchases(spark, d).select(F.col("user_id").cast("string").alias("user"),
                                             F.col("item_id").cast("string").alias("item"),
                                             tf.norm_name(F.col("name")).alias("name"))
    # one pass: every row offers its three values
    offers = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value"))
                                 for c in ("user", "item", "name")]))
    return rows.select(offers.alias("o")).select("o.side", "o.value").distinct()


@query("unseen_items", """
SELECT user_id, CAST(count(DISTINCT item_id) AS BIGINT) AS n_seen,
  CAST((SELECT count(DISTINCT item_id) FROM tr) - count(DISTINCT item_id) AS BIGINT) AS n_unseen FROM tr GROUP BY user_id""")
def unseen_items(spark, d):
    return longs(toplists.open_item_counts(stored_train(spark, d)), "n_unseen")
