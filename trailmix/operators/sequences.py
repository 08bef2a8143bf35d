"""Per-user sequences: examples, consecutive pairs, recent items, prompts.

Positions come from ``spread.positions`` and windows run over blocks of a sequence, so
a user with a large share of the log is shared out over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import norm_name
from .logs import dedupe_last, newest_first, ordered_history
from .spread import first_per_group, positions, sequence_blocks

# Prompt texts, and the example window.
INSTRUCTION = ("Given a list of restaurants the user has visited in chronological order, "
               "predict the restaurant the user will visit next.")
SYSTEM_PROMPT = "You are a restaurant recommendation system."
INPUT_PREFIX = "Restaurants visited: "
MIN_CONTEXT = 3
MAX_HISTORY = 15
# Query sizes of the home-feed ranker.
RECENT_CHOICES = (1, 2, 3, 5, 10, 20)


def sliding_examples(train: DataFrame, min_ctx: int = MIN_CONTEXT,
                     max_hist: int = MAX_HISTORY) -> DataFrame:
    """user_id, pos, context (up to ``max_hist`` earlier names), target."""
    blocks = sequence_blocks(ordered_history(train).select("user_id", "pos", "name"), halo=max_hist)
    before = W.partitionBy("user_id", "block_no").orderBy("pos").rowsBetween(-max_hist, -1)
    return (blocks.withColumn("context", F.collect_list("name").over(before))
            .where(~F.col("is_halo") & (F.col("pos") > min_ctx))
            .select("user_id", "pos", "context", F.col("name").alias("target")))


def instruction_examples(windows: DataFrame) -> DataFrame:
    """The text form of the sliding examples."""
    return windows.select(
        "user_id", "pos", F.lit(INSTRUCTION).alias("instruction"),
        F.concat(F.lit(INPUT_PREFIX), F.array_join("context", ", ")).alias("input"),
        F.col("target").alias("output"))


def chat_messages(examples: DataFrame) -> DataFrame:
    """System, user and assistant turns of an example as an array of structs."""
    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return examples.select("user_id", "pos", F.array(
        turn("system", F.lit(SYSTEM_PROMPT)),
        turn("user", F.concat_ws("\n\n", "instruction", "input")),
        turn("assistant", F.col("output"))).alias("messages"))


def leakage_check(examples: DataFrame, test: DataFrame, train: DataFrame) -> DataFrame:
    """One row: examples that target the held-out name although train never shows it."""
    held = test.select("user_id", norm_name(F.col("name")).alias("_target"))
    seen = train.select("user_id", F.col("name").alias("output")).distinct()
    return (examples.select("user_id", "output").join(held, "user_id")
            .where(norm_name(F.col("output")) == F.col("_target"))
            .join(seen, ["user_id", "output"], "left_anti")
            .agg(F.count("*").alias("leaks")))


def consecutive_pairs(train: DataFrame) -> DataFrame:
    """user_id, pos, q, i: item ``i`` was visited right after a different item ``q``."""
    seq = positions(dedupe_last(train).select("user_id", "item_id", "ts", "seq"),
                    ["user_id"], ["ts", "seq"]).select("user_id", "pos", "item_id")
    prev = F.lag("item_id").over(W.partitionBy("user_id", "block_no").orderBy("pos"))
    return (sequence_blocks(seq).withColumn("q", prev).where(~F.col("is_halo"))
            .where(F.col("q") != F.col("item_id"))
            .select("user_id", "pos", "q", F.col("item_id").alias("i")))


def recent_items(train: DataFrame, k: int = max(RECENT_CHOICES)) -> DataFrame:
    """user_id, item_id, recency: the last ``k`` distinct items, 1 = newest; a repeated item counts once."""
    rows = dedupe_last(train).select("user_id", "item_id", "ts", "seq")
    return (first_per_group(rows, ["user_id"], newest_first(), k, rank="recency")
            .select("user_id", "item_id", "recency"))


def recent_context(train: DataFrame, k: int = MAX_HISTORY) -> DataFrame:
    """user_id, context: the last ``k`` names, oldest first."""
    rows = train.select("user_id", "name", "ts", "seq")
    last = first_per_group(rows, ["user_id"], newest_first(), k, rank="recency")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), "name")))
    return (last.groupBy("user_id").agg(pairs.alias("_pairs"))      # at most k rows per user
            .select("user_id", F.transform("_pairs", lambda p: p["name"]).alias("context")))


def gap_days(train: DataFrame, test: DataFrame) -> DataFrame:
    """Median days from the query item to the target, for the validation and test steps."""
    rows = dedupe_last(train).select("user_id", "ts", "seq")
    last = first_per_group(rows, ["user_id"], newest_first(), 2, rank="_r")
    last = last.groupBy("user_id").agg(F.max(F.when(F.col("_r") == 1, F.col("ts"))).alias("_last"),
                                       F.max(F.when(F.col("_r") == 2, F.col("ts"))).alias("_prev"))
    gaps = last.join(test.select("user_id", F.col("ts").alias("_test")), "user_id", "left").select(
        F.datediff("_last", "_prev").alias("v"), F.datediff("_test", "_last").alias("t"))
    return gaps.agg(F.median("v").alias("validation_gap_days"), F.median("t").alias("test_gap_days"))
