"""From scored candidates to ranked lists of distinct names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .logs import dedupe_last, global_mean, item_names, item_stats
from .spread import first_per_group, global_index, numbered, positions

# List length, and the eligibility limit of the rank-based model.
TOP_N = 10
MIN_RATERS = 50
# Scores are compared after rounding: a distributed sum depends on its order.
SCORE_DIGITS = 9
# Places of a shared order that every user may ask for, and the groups of users they are copied for.
HEAD, SALTS = 4096, 64


def mask_seen(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """Drop (user, item) candidates that occur in train."""
    return candidates.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def mask_seen_names(lists: DataFrame, histories: DataFrame) -> DataFrame:
    """Drop (user, name) rows whose name occurs in the user's history."""
    return lists.join(histories.select("user_id", "name"), ["user_id", "name"], "left_anti")


def best_per_name(scored: DataFrame) -> DataFrame:
    """Per user and name the best item: highest score, then lowest item id."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("item_id").alias("item_id")))
    return (scored.groupBy("user_id", "name").agg(best.alias("_best"))
            .select("user_id", "name", F.col("_best.item_id").alias("item_id"),
                    (-F.col("_best.neg")).alias("score")))


def by_score() -> list:
    return [F.col("score").desc(), F.col("item_id").asc()]


def top_n_names(candidates: DataFrame, seen: DataFrame | None, names: DataFrame, n: int = TOP_N,
                depth: int | None = None) -> DataFrame:
    """user_id, rank, name, item_id, score: the first ``n`` distinct names per user.

    Non-finite scores are dropped, seen items removed by id. With ``depth`` only the
    best ``depth`` items of a user enter the name step, so lists may be short.
    """
    finite = ~F.isnan("score") & (F.abs(F.col("score")) < F.lit(float("inf")))
    scored = (candidates.where(F.col("score").isNotNull() & finite)
              .select("user_id", "item_id", F.round("score", SCORE_DIGITS).alias("score")))
    if seen is not None:
        scored = mask_seen(scored, seen)
    if depth is not None:
        scored = first_per_group(scored, ["user_id"], by_score(), depth)
    best = best_per_name(scored.join(names, "item_id"))
    return (first_per_group(best, ["user_id"], by_score(), n, rank="rank")
            .select("user_id", "rank", "name", "item_id", "score"))


def _spoiled(taken: DataFrame, n: int) -> DataFrame:
    """user_id, name_place of the best items a user must not get, among the places the user may come to.

    ``taken``: name_place of a user's blocked best items. The i-th of them in the order lies among the places a
    user needs if fewer than n others lie before it, that is below n + i - 1; once one does not, no later one does.
    """
    placed = positions(taken, ["user_id"], ["name_place"], out="_i", dense=True)
    return placed.where(F.col("name_place") < F.col("_i") + (n - 1)).select("user_id", "name_place")


def shared_order_lists(items: DataFrame, users: DataFrame, blocked: DataFrame,
                       n: int = TOP_N) -> DataFrame:
    """Candidates for rankers in which all users share one order of the items.

    ``items``: item_id, name, score, place (0-based rank in the shared order);
    ``blocked``: distinct (user_id, item_id) a user must not get. A user needs the first names at their best
    item until n of these are not blocked; no later name can come before those n. Of a name whose best item is
    blocked the user gets the best of the others: with k blocked items it is among the first k + 1.
    A user's rows are n and those of the names spoiled that way, never users x items. Result: user_id, item_id,
    name, score, place; a name once for each user.
    """
    branches = positions(items, ["name"], ["place"], out="branch", dense=True)
    firsts = materialize(global_index(branches.where(F.col("branch") == 1).drop("branch"), [F.col("place")], "name_place"), "names")
    n_names = firsts.agg(F.count("*")).scalar()
    counts = blocked.groupBy("user_id").agg(F.count("*").alias("_b"))
    # nobody comes further than n places and one for each blocked item
    reach = F.coalesce(counts.agg(F.max("_b")).scalar(), F.lit(0)) + n
    near = materialize(branches.join(firsts.select("name", "name_place"), "name").where(F.col("name_place") < reach), "near")
    taken = materialize(blocked.select("user_id", "item_id").join(near.select("item_id", "name_place", "branch"), "item_id"), "taken")
    spoiled = materialize(_spoiled(taken.where(F.col("branch") == 1), n), "spoiled")
    budget = F.least(F.coalesce(F.col("_s"), F.lit(0)) + n, n_names)
    # Every user asks for the first places. These are copied for SALTS groups of users; a place p after
    # them is asked for by at most |blocked| / (p - n) users.
    head = F.col("name_place") < HEAD
    dealt = F.when(head, F.pmod(F.xxhash64("user_id"), F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(head, SALTS - 1).otherwise(0)))
    asked = users.select("user_id").join(spoiled.groupBy("user_id").agg(F.count("*").alias("_s")), "user_id", "left")
    prefix = (numbered(asked.select("user_id", budget.alias("_budget")), F.col("_budget"), "name_place")
              .join(spoiled, ["user_id", "name_place"], "left_anti").withColumn("_salt", dealt)
              .join(firsts.withColumn("_salt", copies), ["name_place", "_salt"])
              .select("user_id", "item_id", "name", "score", "place"))
    known = taken.join(spoiled, ["user_id", "name_place"], "left_semi")
    tried = numbered(known.groupBy("user_id", "name_place").agg(F.count("*").alias("_k")), F.col("_k"), "_from")
    others = (tried.select("user_id", "name_place", (F.col("_from") + 2).alias("branch"))       # the first one is blocked
              .join(near, ["name_place", "branch"])
              .join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
              .groupBy("user_id", "name").agg(F.min(F.struct("place", "item_id", "score")).alias("_best"))
              .select("user_id", "_best.item_id", "name", "_best.score", "_best.place"))
    return prefix.unionByName(others)


def _lists_by_place(items: DataFrame, users: DataFrame, blocked: DataFrame, n: int) -> DataFrame:
    rows = shared_order_lists(items, users, blocked, n)
    lists = first_per_group(rows, ["user_id"], [F.col("place").asc()], n, rank="rank")
    return lists.select("user_id", "rank", "name", "item_id", "score")


def _shared_ranking(scores: DataFrame, train: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    named = scores.join(item_names(train), "item_id")
    items = materialize(global_index(named, by_score(), "place"), "items")
    if seen is None:
        seen = materialize(train.select("user_id", "item_id").distinct(), "seen")
    return _lists_by_place(items, seen.select("user_id").distinct(), seen, n)


def popularity(train: DataFrame, n: int = TOP_N) -> DataFrame:
    """Lists by number of distinct raters."""
    seen = materialize(train.select("user_id", "item_id").distinct(), "seen")
    scores = seen.groupBy("item_id").agg(F.count("*").cast("double").alias("score"))
    return _shared_ranking(scores, train, n, seen)


def rank_based(train: DataFrame, min_n: int = MIN_RATERS, n: int = TOP_N) -> DataFrame:
    """Lists by mean rating among items with at least ``min_n`` distinct raters."""
    scores = (item_stats(train).where(F.col("n_raters") >= min_n)
              .select("item_id", F.round("mean_rating", SCORE_DIGITS).alias("score")))
    return _shared_ranking(scores, train, n)


def mean_filled_lists(predictions: DataFrame, train: DataFrame, n: int = TOP_N) -> DataFrame:
    """Lists from predictions (user_id, item_id, score) where every other item scores the mean.

    The tier of items at the mean is added as a prefix of the id-ordered catalog, so the
    users x items matrix is never built.
    """
    names = item_names(train)
    seen = train.select("user_id", "item_id").distinct()
    mu = global_mean(train).withColumn("mu", F.round("mu", SCORE_DIGITS)).scalar()
    lists = materialize(top_n_names(predictions, seen, names, n))
    # a user whose n best predictions all beat the mean never reaches the tier
    above = lists.where(F.col("score") > mu).groupBy("user_id").agg(F.count("*").alias("_above"))
    done = above.where(F.col("_above") >= n).select("user_id")
    users = materialize(train.select("user_id").distinct().join(done, "user_id", "left_anti"))
    blocked = (seen.unionByName(predictions.select("user_id", "item_id"))
               .join(users, "user_id", "left_semi").distinct())
    items = global_index(names.withColumn("score", F.lit(0.0)), [F.col("item_id")], "place")
    tier = (shared_order_lists(items, users, blocked, n)
            .select("user_id", "item_id", mu.alias("score")))
    return top_n_names(lists.select("user_id", "item_id", "score").unionByName(tier), None, names, n)


def rated_pairs(train: DataFrame) -> DataFrame:
    """user_id, item_id, rating with duplicates collapsed to the newest."""
    return dedupe_last(train).select("user_id", "item_id", "rating")


def open_item_counts(train: DataFrame) -> DataFrame:
    """Per user the number of train items not yet seen, without listing them."""
    seen = train.select("user_id", "item_id").distinct().groupBy("user_id").agg(
        F.count("*").alias("n_seen"))
    n_items = train.agg(F.count_distinct("item_id")).scalar()
    return seen.withColumn("n_unseen", n_items - F.col("n_seen"))
