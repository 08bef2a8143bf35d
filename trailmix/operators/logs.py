"""Cohorts, splits, duplicates and statistics of an interaction log.

A log has the columns user_id, item_id, name, rating, ts, seq; (ts, seq) is unique per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display_name, norm_name
from ..session import materialize
from .spread import first_by_digest, first_per_group, global_index, positions

# Smallest number of reviews of a cohort user, in the two protocols.
MIN_REVIEWS = 20
MIN_REVIEWS_RATING = 100

ROW_KEY = ["user_id", "ts", "seq"]


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("seq").desc()]


def oldest_first() -> list[Column]:
    return [F.col("ts").asc(), F.col("seq").asc()]


def checked(log: DataFrame) -> DataFrame:
    """Fail on rows the models cannot place: no timestamp, or a rating that is not positive."""
    return (log.withColumn("ts", F.coalesce("ts", F.raise_error(F.lit("interaction without a timestamp"))))
            .withColumn("rating", F.when(F.col("rating") > 0, F.col("rating"))
                        .otherwise(F.raise_error(F.lit("rating must be positive")))))


def user_counts(log: DataFrame) -> DataFrame:
    """Rows per user."""
    return log.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n_rows"))


def cohort_users(log: DataFrame, min_rows: int = MIN_REVIEWS) -> DataFrame:
    """user_id, last: users with at least ``min_rows`` rows, and the time of their newest."""
    counts = log.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.max("ts").alias("last"))
    return counts.where(F.col("n_rows") >= min_rows).select("user_id", "last")


def cohort(log: DataFrame, min_rows: int = MIN_REVIEWS) -> DataFrame:
    """Rows of users with at least ``min_rows`` rows."""
    keep = user_counts(log).where(F.col("n_rows") >= min_rows).select("user_id")
    return log.join(keep, "user_id", "left_semi")


def held_out(log: DataFrame) -> DataFrame:
    """The newest row of each user, by a rank-limited window that prunes before the shuffle."""
    return first_per_group(log, ["user_id"], newest_first())


def without_held_out(log: DataFrame, test: DataFrame) -> DataFrame:
    """All other rows, by an anti join on the unique row key, which spreads a heavy user's rows."""
    return log.join(test.select(*ROW_KEY), ROW_KEY, "left_anti")


def leave_one_out(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, held out): the newest row of each user is held out."""
    test = held_out(log)
    return without_held_out(log, test), test


def check_split(log: DataFrame, train: DataFrame, test: DataFrame) -> None:
    """Fail unless train and held-out rows together are as many as the log's, one held out per user."""
    n_log, n_train, n_test = log.count(), train.count(), test.count()
    users = log.agg(F.count_distinct("user_id")).first()[0]
    if n_train + n_test != n_log or n_test != users:
        raise ValueError(f"split of {n_log} rows and {users} users gives {n_train} train and {n_test} held-out rows")


def dedupe_last(log: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """One row per key: the newest."""
    return first_per_group(log, list(keys), newest_first())


def dedupe_first(log: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """One row per key: the oldest."""
    return first_per_group(log, list(keys), oldest_first())


def validation_split(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fit, validation): leave-one-out once more, on the duplicate-free train rows, which are stored."""
    return leave_one_out(materialize(dedupe_last(train), "deduped"))


def item_names(train: DataFrame) -> DataFrame:
    """Matching name of each item; the newest row decides."""
    rows = train.select("item_id", "name", "ts", "seq")
    return (first_per_group(rows, ["item_id"], newest_first())
            .select("item_id", norm_name(F.col("name")).alias("name")))


def item_stats(train: DataFrame) -> DataFrame:
    """Distinct raters and mean (newest) rating per item."""
    return dedupe_last(train).groupBy("item_id").agg(
        F.count("*").alias("n_raters"), F.avg("rating").alias("mean_rating"))


def user_stats(train: DataFrame) -> DataFrame:
    """Distinct items and mean (newest) rating per user."""
    return dedupe_last(train).groupBy("user_id").agg(
        F.count("*").alias("n_items"), F.avg("rating").alias("mean_rating"))


def global_mean(train: DataFrame) -> DataFrame:
    """Mean rating over all rows, duplicates included: one row, one column ``mu``."""
    return train.agg(F.avg("rating").alias("mu"))


def dataset_summary(log: DataFrame, train: DataFrame, test: DataFrame,
                    examples: DataFrame) -> DataFrame:
    """One row of sizes: users, rows, items, names, split sizes, example lengths."""
    base = log.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("interactions"),
                   F.count_distinct("item_id").alias("items"),
                   F.count_distinct(norm_name(F.col("name"))).alias("names"))
    ex = examples.agg(F.count("*").alias("examples"), F.avg(F.length("input")).alias("mean_len"),
                      F.max(F.length("input")).alias("max_len"))
    return base.select(
        "*", train.agg(F.count("*")).scalar().alias("train_rows"),
        test.agg(F.count("*")).scalar().alias("test_rows"),
        ex.select("examples").scalar().alias("examples"),
        ex.select("mean_len").scalar().alias("input_len_mean"),
        ex.select("max_len").scalar().alias("input_len_max"))


def ordered_history(train: DataFrame) -> DataFrame:
    """Names of each user in time order, one row per position."""
    rows = train.select("user_id", "item_id", display_name(F.col("name")).alias("name"), "ts", "seq")
    return positions(rows, ["user_id"], ["ts", "seq"])


def catalog(log: DataFrame) -> DataFrame:
    """One row per item over train and test rows: first name and its matching form."""
    rows = log.select("item_id", display_name(F.col("name")).alias("name"), "ts", "seq")
    return dedupe_first(rows).select("item_id", "name", norm_name(F.col("name")).alias("norm_name"))


def chains(items: DataFrame) -> DataFrame:
    """Matching names that stand for several items."""
    return (items.groupBy("norm_name").agg(F.count_distinct("item_id").alias("n_items"))
            .where(F.col("n_items") > 1))


def item_attributes(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Attributes aligned to an item list: first raw row per item, null when missing."""
    return align(items, first_per_group(raw, ["item_id"], [F.col("seq").asc()]).drop("seq"))


def align(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """Left join of attributes to the item list."""
    return items.select("item_id").join(attributes, "item_id", "left")


def known_pairs(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and item both occur in train."""
    return (test.join(train.select("user_id").distinct(), "user_id", "left_semi")
            .join(train.select("item_id").distinct(), "item_id", "left_semi"))


def cold_targets(test: DataFrame, train: DataFrame) -> DataFrame:
    """Share of held-out names that never occur in train, and the hit-rate ceiling."""
    known = train.select(norm_name(F.col("name")).alias("name")).distinct()
    targets = test.select("user_id", norm_name(F.col("name")).alias("name"))
    cold = targets.join(known, "name", "left_anti").agg(F.count("*").alias("n_cold"))
    share = F.col("n_cold") / F.col("n_test")
    return (targets.agg(F.count("*").alias("n_test")).withColumn("n_cold", cold.scalar())
            .withColumn("cold_share", share).withColumn("hit_ceiling", 1 - share))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Sorted distinct values numbered 0..n-1."""
    return global_index(distinct_values(df, col), [F.col(col).asc()], out)


def stable_sort(log: DataFrame) -> DataFrame:
    """The whole log in time order, ties by ``seq``."""
    return log.orderBy("ts", "seq")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) chosen by the digest of their unique keys."""
    return first_by_digest(df, keys, seed, F.lit(n), "_in").where("_in").drop("_in")


def random_split(df: DataFrame, keys: list[str], frac: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """Adds ``is_test``: true for exactly round(frac * n) rows."""
    n = df.agg(F.rint(F.count("*") * frac).cast("bigint").alias("n")).scalar()
    return first_by_digest(df, keys, seed, n, "is_test")


def l1_normalize(df: DataFrame, part: list[str], weight: str, out: str) -> DataFrame:
    """Weights divided by their guarded group sum."""
    total = df.groupBy(*part).agg(F.sum(weight).alias("_total"))
    return (df.join(total, part)
            .withColumn(out, F.col(weight) / F.greatest(F.col("_total"), F.lit(1e-12)))
            .drop("_total"))
