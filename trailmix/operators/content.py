"""Item content: category and token bags, city index, standardised numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, hash_tokens, strip
from .logs import align, dense_index

# Widths of the content blocks and scale of seeded tables.
D_CATEGORY, D_NAME, D_CITY = 64, 64, 16
TABLE_STD = 0.05
SMALL = 1e-9


def _categories(items: DataFrame) -> DataFrame:
    words = F.transform(F.split(F.coalesce("categories", F.lit("")), ";"), strip)
    return items.select("item_id", F.explode_outer(F.filter(words, lambda c: c != "")).alias("category"))


def category_bag(items: DataFrame) -> DataFrame:
    """item_id, category, id: ids from the sorted vocabulary; none -> one row with the next id."""
    rows = _categories(items)
    vocab = dense_index(rows.where(F.col("category").isNotNull()), "category", "id")
    size = vocab.agg(F.count("*")).scalar()
    return (rows.join(vocab, "category", "left")
            .select("item_id", "category", F.coalesce("id", size).cast("bigint").alias("id")))


def name_bag(items: DataFrame) -> DataFrame:
    """item_id, id: hashed token buckets of the name."""
    return items.select("item_id", F.explode(hash_tokens(F.col("name"))).alias("id"))


def city_index(items: DataFrame) -> DataFrame:
    """item_id, city, id: ids from the sorted cities; a missing city is ``?``."""
    rows = items.select("item_id", F.lower(strip(F.coalesce("city", F.lit("?")))).alias("city"))
    return rows.join(dense_index(rows, "city", "id"), "city").select("item_id", "city", "id")


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as z-scores with the population deviation."""
    # one aggregate of one row, read by one subquery
    stats = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("s"))
    rows = df.withColumn("_s", stats.scalar())
    return rows.withColumns({c: (F.col(c) - F.col(f"_s.m_{c}")) / (F.col(f"_s.s_{c}") + SMALL) for c in cols}).drop("_s")


def numeric_features(items: DataFrame, fit: DataFrame) -> DataFrame:
    """item_id, degree, star, lat, lon, is_open from the rows of the fit split only.

    ``fit`` holds distinct pairs; an item without rows has degree 0 and the mean star.
    """
    stats = fit.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    mean_star = stats.agg(F.avg("m")).scalar()
    base = align(items, items.select("item_id", "lat", "lon", "is_open")).join(stats, "item_id", "left").select(
        "item_id", F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("degree"),
        (F.coalesce("m", mean_star) / 5.0).alias("star"), "lat", "lon",
        F.coalesce("is_open", F.lit(True)).cast("double").alias("is_open"))
    return standardize(base, ["degree", "lat", "lon"])


def seeded_table(ids: DataFrame, kind: str, dim: int, seed: int = 42, std: float = TABLE_STD) -> DataFrame:
    """id, vec: reproducible uniform values with deviation ``std``."""
    def value(d: Column) -> Column:
        return (draw(F.lit(kind), F.col("id"), d, seed) / 2.0 ** 32 - 0.5) * (std * 12 ** 0.5)

    return ids.select("id").distinct().select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vec"))


def pooled(bag: DataFrame, table: DataFrame) -> DataFrame:
    """item_id, vec: mean of the table rows of a bag, computed with partial aggregation."""
    rows = bag.join(table, "id").select("item_id", array_to_vector("vec").alias("v"))
    return rows.groupBy("item_id").agg(Summarizer.mean(F.col("v")).alias("v")).select(
        "item_id", vector_to_array("v").alias("vec"))


def content_vectors(items: DataFrame, fit: DataFrame, tables: dict[str, DataFrame] | None = None,
                    dims: tuple[int, int, int] = (D_CATEGORY, D_NAME, D_CITY), seed: int = 42) -> DataFrame:
    """item_id, vec: category block, name block, city block, five numbers.

    ``tables`` may supply the lookup tables (category, name, city: id, vec).
    """
    bags = {"category": category_bag(items).select("item_id", "id"), "name": name_bag(items),
            "city": city_index(items).select("item_id", "id")}
    tables = tables or {k: seeded_table(b, k, n, seed) for (k, b), n in zip(bags.items(), dims)}
    blocks = [pooled(bags[k], tables[k]).withColumnRenamed("vec", k) for k in bags]
    numbers = numeric_features(items, fit).select(
        "item_id", F.array("degree", "star", "lat", "lon", "is_open").alias("numbers"))
    whole = reduce(lambda a, b: a.join(b, "item_id"), [*blocks, numbers])
    return whole.select("item_id", F.concat("category", "name", "city", "numbers").alias("vec"))
