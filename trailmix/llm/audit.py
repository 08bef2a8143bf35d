"""How filters interact: what each removes, alone and in every order in which they can be applied.

The documents are reduced to a table of mask cells: for each part (source) and each set of filters that a
document fails, how many documents there are. All orders are then enumerated on that small table by a
recursive common table expression, so the texts are read once, whatever the number of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import WORD, words

# The filters' letters and their bits in a mask.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}


def failures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, mask (bits of the failed filters A to D) and the digest of the text.

    A: under 50 words; B: distinct words under 65 % of the words; C: capitals A-Z over 5 % of the code
    points; D: one of ``#$%&*|``. A null text is an empty one and fails A only.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    n = F.size("words")
    capitals = F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = {"A": n < 50, "B": 100 * F.size(F.array_distinct("words")) < 65 * n,
             "C": 100 * capitals > 5 * F.char_length("text"), "D": F.col("text").rlike(r"[#$%&*|]")}
    mask = sum((F.when(failed, BITS[letter]).otherwise(0) for letter, failed in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, good ones and toxic ones of each part and set of failed filters.

    Filter E fails a row whose text (by SHA-256) some row with a smaller doc_id has as well; so the rows of
    a text's smallest doc_id pass, and rows without a doc_id, which is not smaller than any. Rows are
    counted by their content before they are moved, and no step brings all copies of a text, or all rows
    without an id, to one task: the smallest id of a text is a partial minimum, and it is joined back by
    text and id. A document counts as good (toxic) if any of its label rows says so. Empty tables give none.
    """
    rows = materialize(failures(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "failures")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where(F.col("doc_id").isNotNull()).join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    nameless = rows.where(F.col("doc_id").isNull()).select("*", F.lit(True).alias("first"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    columns = ["part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(BITS["E"])).alias("mask"),
               "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")]]
    both = known.select(*columns).unionAll(nameless.select(*columns))
    return both.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])


# The recursion extends each prefix by every unused letter; it carries the masks that occur (32 at most)
# with the bits applied so far, so its size does not depend on the data: 325 prefixes times the masks.
# Each level states, for every mask, what the step does to documents that fail just these filters.
ORDERS = """
WITH RECURSIVE masks AS (SELECT DISTINCT mask FROM {cells}),
prefixes(step, prefix, letter, bit, applied, mask, gone) AS (
  SELECT 0, CAST('' AS STRING), CAST('' AS STRING), 0, 0, mask, 0 FROM masks
  UNION ALL
  SELECT p.step + 1, concat(p.prefix, p.next.letter), p.next.letter, p.next.bit, p.applied | p.next.bit, p.mask,
    CASE WHEN p.mask & p.applied <> 0 THEN 1 ELSE 0 END
  FROM (SELECT *, explode(filter(
          array(named_struct('letter', 'A', 'bit', 1), named_struct('letter', 'B', 'bit', 2),
                named_struct('letter', 'C', 'bit', 4), named_struct('letter', 'D', 'bit', 8),
                named_struct('letter', 'E', 'bit', 16)), x -> applied & x.bit = 0)) AS next
        FROM prefixes WHERE step < 5) p
  JOIN masks m ON m.mask = p.mask)
SELECT step, prefix, letter, bit, applied, mask, gone FROM prefixes WHERE step > 0"""


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley); zeros included.

    kept: left after the step; removed: by it; redundant: failing its filter, removed earlier;
    unique_fails: failing its filter only; good_lost, toxic_lost: labelled documents removed by it;
    shapley: what its filter removes, summed over all 120 orders. Null sources are the part ''.
    """
    counted = materialize(cells(docs, labels), "cells")
    steps = materialize(docs.sparkSession.sql(ORDERS, cells=counted), "orders")
    now = (F.col("gone") == 0) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)
    sums = {"kept": ((F.col("mask").bitwiseAND(F.col("applied")) == 0), "n"), "removed": (now, "n"),
            "redundant": ((F.col("gone") == 1) & (F.col("mask").bitwiseAND(F.col("bit")) != 0), "n"),
            "unique_fails": (F.col("mask") == F.col("bit"), "n"), "good_lost": (now, "good"), "toxic_lost": (now, "toxic")}
    metrics = counted.join(steps, "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.when(which, F.col(what)).otherwise(0)).cast("bigint").alias(name) for name, (which, what) in sums.items()])
    metrics = materialize(metrics, "metrics")
    # a prefix of k letters begins (5 - k)! orders
    shares = metrics.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(5 - F.col("step"))).alias("shapley"))
    orders = (steps.where("step = 5").select(F.col("prefix").alias("filter_order")).distinct()
              .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
              .withColumn("prefix", F.expr("left(filter_order, step)")))
    return (metrics.join(shares, ["part", "letter"]).drop("step").join(orders, "prefix")
            .select("part", "filter_order", "step", *sums, "shapley"))


AUDITED_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM t),
f AS (
  SELECT doc_id, part, text, (len(words) < 50)::INT
    + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT AS abcd FROM w),
e AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT part, abcd + CASE WHEN f.doc_id > first THEN 16 ELSE 0 END AS mask, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f JOIN e USING (text) LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY 1, 2),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, step, letter, bit, before) AS (
  SELECT letter, 1, letter, bit, 0 FROM letters
  UNION ALL
  SELECT p.prefix || l.letter, p.step + 1, l.letter, l.bit, p.before + p.bit
  FROM p, letters l WHERE (p.before + p.bit) & l.bit = 0),
s AS MATERIALIZED (
  SELECT part, prefix, step, letter,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM m, p GROUP BY ALL),
o AS MATERIALIZED (
  SELECT s.part, o.prefix AS filter_order, s.step, s.letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
  FROM p o JOIN s ON s.prefix = left(o.prefix, s.step) WHERE o.step = 5)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM o"""
