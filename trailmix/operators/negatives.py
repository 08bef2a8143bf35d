"""Negative sampling and the losses evaluated on the samples.

Draws are digests of row keys, mapped to items through a dense index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot, draw, relu
from ..session import materialize
from .logs import dense_index
from .spread import positions, running_total

# Negatives per positive, shared negatives and pairs per batch, rank band and
# ceiling of the hard negatives, margin of the loss.
N_NEGATIVES = 16
N_SHARED, BATCH = 500, 2048
HARD_BAND, MAX_HARD = (500, 2000), 6
MARGIN = 0.1
# Rounds of rejection before a negative is picked from the complement directly.
ROUNDS = 2


def hard_count(epoch: int, ceiling: int = MAX_HARD) -> int:
    """Curriculum: epoch n uses n - 1 hard negatives, up to the ceiling."""
    return max(0, min(epoch - 1, ceiling))


def slots(n: int):
    """One row for each of 0..n-1; none for n = 0, where a sequence would count down."""
    return F.explode(F.array(*[F.lit(k) for k in range(n)]) if n else F.array().cast("array<int>"))


def _n_rows(df: DataFrame):
    return df.agg(F.count("*")).scalar()


def sample_negatives(positives: DataFrame, seen: DataFrame, items: DataFrame, n: int = N_NEGATIVES,
                     seed: int = 42, epoch: int = 1) -> DataFrame:
    """user_id, item_id, slot, negative: ``n`` uniform unseen items per positive row.

    ``positives`` are distinct (user_id, item_id). A draw that hits a seen item is drawn
    again ``ROUNDS`` times in all; what is left (users who saw almost everything) picks the
    r-th unseen item directly: with the user's seen indexes sorted as s_1 < s_2 < ..., the
    r-th unseen index is r + |{j : s_j - (j - 1) <= r}|. Users who saw all items get none.
    """
    index = materialize(dense_index(items, "item_id"), "index")
    total = _n_rows(index)
    lookup = index.select(F.col("idx").alias("_idx"), F.col("item_id").alias("negative"))
    seen = seen.select("user_id", "item_id").distinct()
    taken = seen.select("user_id", F.col("item_id").alias("negative"), F.lit(True).alias("_taken"))
    slot = slots(n)
    open_rows = positives.select("user_id", "item_id", slot.alias("slot"))
    keys = ["user_id", "item_id", "slot"]
    found = []
    for attempt in range(ROUNDS):
        number = draw(*[F.col(k) for k in keys], attempt, epoch, seed) % total
        tried = materialize(open_rows.withColumn("_idx", number).join(lookup, "_idx")
                            .join(taken, ["user_id", "negative"], "left"), "draws")
        found.append(tried.where(F.col("_taken").isNull()).select(*keys, "negative"))
        open_rows = tried.where("_taken").select(*keys)
    users = open_rows.select("user_id").distinct()
    own = (seen.join(users, "user_id", "left_semi").join(index, "item_id")
           .select("user_id", "idx"))
    gaps = positions(own, ["user_id"], ["idx"], dense=True).select(
        "user_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
        F.lit(None).cast("int").alias("slot"), (F.col("idx") - F.col("pos") + 1).alias("_v"), F.lit(1).alias("_one"))
    n_own = own.groupBy("user_id").agg(F.count("*").alias("_n"))
    picks = (open_rows.join(n_own, "user_id").where(F.col("_n") < total)
             .select(*keys, (draw(*[F.col(k) for k in keys], ROUNDS, epoch, seed) % (total - F.col("_n"))).alias("_v"),
                     F.lit(0).alias("_one")))
    counted = running_total(gaps.unionByName(picks), ["user_id"], F.floor(F.col("_v") / 4096),
                            [F.col("_v"), F.col("_one").desc()], F.col("_one"), "_below")
    rest = (counted.where("_one = 0").withColumn("_idx", F.col("_v") + F.col("_below"))
            .join(lookup, "_idx").select(*keys, "negative"))
    out = rest
    for part in found:
        out = out.unionByName(part)
    return out


def labelled_union(positives: DataFrame, negatives: DataFrame, seed: int = 42) -> DataFrame:
    """user_id, item_id, label, shuffle_key: positives with 1, negatives with 0."""
    pos = positives.select("user_id", "item_id", F.lit(1).alias("label"), F.lit(-1).alias("_s"), F.lit("").alias("_o"))
    neg = negatives.select("user_id", F.col("negative").alias("item_id"), F.lit(0).alias("label"),
                           F.col("slot").alias("_s"), F.col("item_id").cast("string").alias("_o"))
    both = pos.unionByName(neg)
    key = draw(F.col("user_id"), F.col("item_id"), F.col("_s"), F.col("_o"), seed)
    return both.withColumn("shuffle_key", key).drop("_s", "_o")


def with_batches(pairs: DataFrame, keys: list[str], batch: int = BATCH, seed: int = 42) -> DataFrame:
    """Adds ``batch``: pairs dealt by digest into batches of about ``batch`` rows."""
    n = F.ceil(_n_rows(pairs) / batch)
    return pairs.withColumn("batch", draw(*[F.col(k) for k in keys], "batch", seed) % n)


def batch_items(pairs: DataFrame, items: DataFrame, n: int = N_SHARED, seed: int = 42) -> DataFrame:
    """batch, slot, negative: ``n`` uniform items per batch."""
    index = dense_index(items, "item_id")
    drawn = pairs.select("batch").distinct().select("batch", slots(n).alias("slot"))
    return (drawn.withColumn("idx", draw(F.col("batch"), F.col("slot"), "shared", seed) % _n_rows(index))
            .join(index, "idx").select("batch", "slot", F.col("item_id").alias("negative")))


def shared_negatives(pairs: DataFrame, items: DataFrame, n: int = N_SHARED, seed: int = 42) -> DataFrame:
    """Pairs x the items of their batch, without a pair's own positive item."""
    return pairs.join(batch_items(pairs, items, n, seed), "batch").where(F.col("negative") != F.col("i"))


def hard_negatives(ranked: DataFrame, n_hit: DataFrame, items: DataFrame, pairs: DataFrame, keys: list[str],
                   h: int, band: tuple[int, int] = HARD_BAND, seed: int = 42) -> DataFrame:
    """keys, q, i, slot, negative: ``h`` items per pair from a band of the query's ranking.

    0-based ranks lo..hi-1, limited to what the query reached and to the depth its ranking is
    stored to; a query with no more than ``lo`` such ranks gets uniform items. ``h`` = 0 gives no rows.
    """
    lo, hi = band
    index = materialize(dense_index(items, "item_id"), "index")
    depth = ranked.groupBy(F.col("src").alias("q")).agg(F.max("rank").alias("_depth"))
    avail = F.greatest(F.least(F.col("n_hit"), F.coalesce("_depth", F.lit(0)), F.lit(hi)) - lo, F.lit(0))
    slot = slots(h)
    rows = (pairs.select(*keys, "q", "i").join(n_hit.withColumnRenamed("src", "q"), "q").join(depth, "q", "left")
            .select(*keys, "q", "i", avail.alias("_avail"), slot.alias("slot"))
            .withColumn("_draw", draw(*[F.col(k) for k in keys], F.col("slot"), "hard", seed)))
    near = (rows.where(F.col("_avail") > 0)
            .withColumn("rank", (lo + F.col("_draw") % F.col("_avail") + 1).cast("int"))
            .join(ranked.select(F.col("src").alias("q"), "rank", F.col("dst").alias("negative")), ["q", "rank"]))
    far = (rows.where(F.col("_avail") == 0).withColumn("idx", F.col("_draw") % _n_rows(index))
           .join(index.select("idx", F.col("item_id").alias("negative")), "idx"))
    cols = [*keys, "q", "i", "slot", "negative"]
    return near.select(*cols).unionByName(far.select(*cols))


def _pair_vectors(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    q = vectors.select(F.col("item_id").alias("q"), F.col("vec").alias("zq"))
    i = vectors.select(F.col("item_id").alias("i"), F.col("vec").alias("zi"))
    return pairs.join(q, "q").join(i, "i")


def _shared_sums(vectors: DataFrame, pairs: DataFrame, negatives: DataFrame, delta: float) -> DataFrame:
    """Sums over each batch's pairs x negatives block: one matrix product per batch."""
    left = _pair_vectors(vectors, pairs).select("batch", "i", "zq", "zi")
    right = (negatives.join(vectors.select(F.col("item_id").alias("negative"), F.col("vec").alias("zn")), "negative")
             .select(F.col("batch").alias("block"), "negative", "zn"))

    def block(p: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if p.empty or n.empty:
            return pd.DataFrame({"hinge": [], "logsig": [], "valid": [], "pos": [], "pairs": []})
        zq, zi, zn = (np.stack(x) for x in (p["zq"], p["zi"], n["zn"]))
        own = np.einsum("ij,ij->i", zq, zi)
        scores = zq @ zn.T
        valid = p["i"].to_numpy()[:, None] != n["negative"].to_numpy()[None, :]
        hinge = np.maximum(scores - own[:, None] + delta, 0.0)
        return pd.DataFrame({
            "hinge": [float(hinge[valid].sum())], "logsig": [float(-np.logaddexp(0.0, scores[valid]).sum())],
            "valid": [int(valid.sum())], "pos": [float(-np.logaddexp(0.0, -own).sum())], "pairs": [len(own)]})

    return left.groupBy("batch").cogroup(right.groupBy("block")).applyInPandas(
        block, "hinge double, logsig double, valid bigint, pos double, pairs bigint")


def margin_loss(vectors: DataFrame, pairs: DataFrame, shared: DataFrame, hard: DataFrame | None = None,
                delta: float = MARGIN) -> DataFrame:
    """One row ``loss``: mean hinge over all valid shared and hard negatives."""
    sums = _shared_sums(vectors, pairs, shared, delta).select("hinge", "valid")
    if hard is not None:
        zn = vectors.select(F.col("item_id").alias("negative"), F.col("vec").alias("zn"))
        rows = _pair_vectors(vectors, hard.where(F.col("negative") != F.col("i"))).join(zn, "negative")
        hinge = relu(dot(F.col("zq"), F.col("zn")) - dot(F.col("zq"), F.col("zi")) + delta)
        sums = sums.unionByName(rows.agg(F.coalesce(F.sum(hinge), F.lit(0.0)).alias("hinge"),
                                         F.count("*").alias("valid")))
    return sums.agg((F.sum("hinge") / F.greatest(F.sum("valid"), F.lit(1))).alias("loss"))


def xent_loss(vectors: DataFrame, pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """One row ``loss``: negative mean log-sigmoid of positives and of negated shared negatives."""
    sums = _shared_sums(vectors, pairs, shared, 0.0)
    return sums.agg((-(F.sum("pos") / F.sum("pairs")
                       + F.sum("logsig") / F.greatest(F.sum("valid"), F.lit(1)))).alias("loss"))
