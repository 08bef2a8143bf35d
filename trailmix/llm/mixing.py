"""Mixing sources to target weights: whole repetitions plus a seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import global_index
from ..session import materialize
from .words import draw, n_words

# Weights of the sources in code-point order, repeating; no document is taken more often than this.
CYCLE = (1, 2, 3)
MOST = 3


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    All sizes are shared out by weight; a target stops at ``most`` times its source's size and the
    excess goes to the other sources by weight, until no target is above its limit. Every round of
    that is one aggregate over the table of sources, of which the driver sees two numbers. A null
    source is a source and comes last; a source without words has the target zero.
    """
    table = global_index(sizes.groupBy("source").agg(F.sum("size").alias("source_size")),
                         [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_place") % len(cycle) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", weight.alias("_weight")), "sources")
    limit = most * F.col("source_size")
    level, full = 0.0, None
    while True:
        above = F.col("_weight") * F.lit(level) > limit
        at_limit, total, capped, weights = table.agg(
            F.count(F.when(above, 1)), F.sum("source_size"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0))).first()
        if at_limit == full or not total or not weights:
            break
        full, level = at_limit, (total - capped) / weights
    above = F.col("_weight") * F.lit(level) > limit
    return table.select("source", "source_size",
                        F.when(above, limit.cast("double")).otherwise(F.col("_weight") * F.lit(level)).alias("target"))


def copies(key, seed: str):
    """How often a document is taken: floor(rate) times and once more with the fraction as probability."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def _with_targets(docs: DataFrame, targets: DataFrame, salts: int) -> DataFrame:
    """Documents joined with their source's row. Beyond Spark's own broadcast limit a source may hold
    a third of all rows, so its documents are dealt out over ``salts`` copies of the source's row."""
    right = targets.select(F.col("source").alias("_source"), "source_size", "target",
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    left = docs.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_deal") == F.col("_salt"))
    return left.join(right, on).drop("_source", "_salt", "_deal")


def taken(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = "mix",
          salts: int = 32) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``; ``taken`` counts words.

    A document without words has size and taken zero. Rows with one doc_id share one draw, so
    repeated rows are taken alike. Other columns, whatever their names, are not looked at.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rows = _with_targets(sized, source_targets(sized, cycle, most), salts)
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * copies(F.col("doc_id"), seed)).alias("taken"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST, seed: str = "mix",
        salts: int = 32) -> DataFrame:
    """Every document as many times as it is taken, with the columns of ``docs``."""
    columns = docs.columns
    targets = source_targets(docs.select("source", n_words(F.col("text")).alias("size")), cycle, most)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    rows = _with_targets(docs.select("doc_id", "source", row), targets, salts)
    return (rows.select("_row", F.explode(F.array_repeat(F.lit(1), copies(F.col("doc_id"), seed).cast("int"))))
            .select("_row.*"))


MIXED_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS rn,
    (CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS lvl
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lvl, rn) FILTER (WHERE w * lvl <= 3 * source_size) AS lvl FROM o),
t AS (
  SELECT source, source_size,
    CASE WHEN w * l.lvl > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE w * l.lvl END AS target
  FROM s, l),
r AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CAST(draw < rate - floor(rate) AS INT)) AS BIGINT) AS taken
FROM r
"""
