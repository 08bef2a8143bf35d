"""Connected components of an edge table by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a vertex, and the vertex, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("_m"))
    moved = down.join(low, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(low.select("u", F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, root) for every vertex of an edge, root being the smallest vertex it reaches.

    Each round is four shuffles of rows the size of the edge table; the number of rounds grows with
    the logarithm of the longest path. Every round is stored in the shared folder, so a lost executor
    costs no more than the round at work. Edges with a null end and loops add nothing; repeated
    edges count once; an empty table gives an empty result.
    """
    edges = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
             .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))))
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots)
