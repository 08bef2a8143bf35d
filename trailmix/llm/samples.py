"""Bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CLASSES = 500


def by_class(rows: DataFrame, label: str, key: Column, per_class: int, seed: int = 0) -> DataFrame:
    """About ``per_class`` rows of each class, or all it has, chosen by the hash of ``key``.

    The choice is a filter on each row, so nothing is sorted, moved or capped in one task: counts of
    the (at most ``MOST_CLASSES`` most frequent) classes become a fraction for each class. The sample
    has at most ``per_class`` rows of a class on average. A null class or key is never chosen.
    """
    counts = (rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), label).limit(MOST_CLASSES).collect())
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.lit(False)
    for row in counts:
        chosen = F.when(F.col(label) == row[label], place < per_class / row["n"]).otherwise(chosen)
    return rows.where(F.col(label).isNotNull() & key.isNotNull() & chosen)
