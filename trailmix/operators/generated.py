"""Clean-up and diagnostics of lists that a text generator produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import norm_name
from .spread import first_per_group
from .toplists import TOP_N, mask_seen_names


def history_names(train: DataFrame) -> DataFrame:
    """Distinct (user_id, matching name) of the train rows."""
    return train.select("user_id", norm_name(F.col("name")).alias("name")).distinct()


def distinct_beams(raw: DataFrame) -> DataFrame:
    """user_id, name, rank of the unfiltered list: blanks and repeats dropped, beam order kept."""
    names = raw.select("user_id", "pos", norm_name(F.col("text")).alias("name")).where("name <> ''")
    first = names.groupBy("user_id", "name").agg(F.min("pos").alias("pos"))
    order = W.partitionBy("user_id").orderBy("pos")          # a user has as many rows as beams
    return first.select("user_id", "name", F.row_number().over(order).alias("rank"))


def clean_lists(raw: DataFrame, histories: DataFrame, n: int = TOP_N) -> DataFrame:
    """user_id, name, rank: the first ``n`` distinct generated names not in the history."""
    fresh = mask_seen_names(distinct_beams(raw), histories).withColumnRenamed("rank", "_raw")
    return (first_per_group(fresh, ["user_id"], [F.col("_raw").asc()], n, rank="rank")
            .select("user_id", "name", "rank"))


def in_catalog(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``in_catalog`` to (user_id, name, ...) rows."""
    known = items.select(F.col("norm_name").alias("name")).distinct().withColumn("_known", F.lit(True))
    return (lists.join(known, "name", "left")
            .withColumn("in_catalog", F.coalesce("_known", F.lit(False))).drop("_known"))


def catalog_restrict(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Only rows whose name exists in the catalog."""
    return lists.join(items.select(F.col("norm_name").alias("name")).distinct(), "name", "left_semi")


def allowed_candidates(proposals: DataFrame, histories: DataFrame, items: DataFrame) -> DataFrame:
    """Proposed (user, name) rows that are in the catalog and not in the user's history."""
    return mask_seen_names(catalog_restrict(proposals, items), histories)


def candidate_counts(histories: DataFrame, items: DataFrame) -> DataFrame:
    """Per user the size of the catalog without visited names, without listing users x names."""
    names = items.select(F.col("norm_name").alias("name")).distinct()
    total = names.agg(F.count("*")).scalar()
    return (histories.join(names.withColumn("_known", F.lit(1)), "name", "left").groupBy("user_id")
            .agg(F.count("_known").alias("n_visited"))
            .withColumn("n_candidates", total - F.col("n_visited")))


def generation_diagnostics(raw_lists: DataFrame, final_lists: DataFrame, users: DataFrame,
                           items: DataFrame, n: int = TOP_N) -> DataFrame:
    """One row: in-catalog share, dropped share, lists, full lists and mean list length."""
    marks = in_catalog(raw_lists, items).agg(F.count("*").alias("n_raw"),
                                             F.count_if("in_catalog").alias("n_known"))
    sizes = (users.select("user_id").distinct()
             .join(final_lists.groupBy("user_id").agg(F.count("*").alias("_len")), "user_id", "left")
             .select(F.coalesce("_len", F.lit(0)).alias("_len")))
    return sizes.agg(F.count("*").alias("n_lists"), F.count_if(F.col("_len") >= n).alias("full_lists"),
                     F.avg("_len").alias("mean_length"), F.sum("_len").alias("_kept")).select(
        "n_lists", "full_lists", "mean_length",
        (marks.select("n_known").scalar() / marks.select("n_raw").scalar()).alias("in_catalog_share"),
        (1 - F.col("_kept") / marks.select("n_raw").scalar()).alias("dropped_share"))
