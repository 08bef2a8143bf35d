"""Factor models: biased matrix factorisation and pairwise ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, dot, draw
from ..session import materialize
from . import training as tr
from .blocks import blocked_topn
from .logs import dense_index, distinct_values, global_mean, item_names
from .spread import numbered
from .toplists import TOP_N

# Settings of the two models.
MF = {"k": 100, "epochs": 20, "lr": 0.01, "reg": 0.2, "std": 0.1}
BPR = {"k": 100, "iters": 200, "lr": 0.01, "reg": 0.001}
# Iterations whose triples are drawn and stored together; changes no result.
AHEAD = 20


def _entity_rows(params: DataFrame, ids: DataFrame, col: str, key) -> DataFrame:
    return ids.select(col, key.alias("key")).join(params, "key").select(col, "vec")


def _as_users(rows: DataFrame, constant) -> DataFrame:
    first = F.array(F.element_at("vec", 1) + constant)
    vec = F.concat(first, F.slice("vec", 2, F.size("vec") - 1))
    return rows.select("user_id", F.array(vec).alias("vecs"))


def _as_items(rows: DataFrame) -> DataFrame:
    vec = F.concat(F.array(F.lit(1.0)), F.slice("vec", 2, F.size("vec") - 1))
    return rows.select("item_id", F.element_at("vec", 1).alias("bias"), vec.alias("vec"))


def biased_mf(train: DataFrame, k: int = MF["k"], epochs: int = MF["epochs"], lr: float = MF["lr"],
              reg: float = MF["reg"], seed: int = 1, chunk_rows: int = tr.CHUNK_ROWS) -> DataFrame:
    """key, vec ([bias, factors...]) fitted to every train row, duplicates included.

    An epoch takes each (user stratum, item stratum) once; all rows of a step move their users and items
    together, so no result depends on order or chunks.
    """
    mu = global_mean(train).first()["mu"]                        # one number
    keys = F.array(tr.user_key(), tr.item_key())
    rows = train.select("user_id", "item_id", keys.alias("keys"), F.col("rating").alias("y"),
                        tr.stratum(F.col("user_id"), F.col("item_id")).alias("step"))
    examples = tr.stored_examples(rows, chunk_rows)
    params = materialize(tr.initial_rows(examples.needs, k, MF["std"], seed), "params")
    for _ in range(epochs):
        for step in range(tr.STRATA):
            params = materialize(tr.damped_step(examples, step, params, tr.squared_gradient(mu), lr, reg), "params")
    return params


def mf_predict(params: DataFrame, pairs: DataFrame, train: DataFrame) -> DataFrame:
    """user_id, item_id, score of given pairs, clipped to the rating range."""
    wanted = pairs.select("user_id", "item_id").distinct()
    users = _entity_rows(params, wanted.select("user_id").distinct(), "user_id", tr.user_key()).withColumnRenamed("vec", "u")
    items = _entity_rows(params, wanted.select("item_id").distinct(), "item_id", tr.item_key()).withColumnRenamed("vec", "i")
    size = F.size("u") - 1
    product = dot(F.slice("u", 2, size), F.slice("i", 2, size))
    score = global_mean(train).scalar() + F.element_at("u", 1) + F.element_at("i", 1) + product
    return (wanted.join(users, "user_id").join(items, "item_id")
            .select("user_id", "item_id", clip(score).alias("score")))


def factor_lists(params: DataFrame, train: DataFrame, constant=None, n: int = TOP_N) -> DataFrame:
    """Lists over all items by constant + b_u + b_i + p.q."""
    constant = F.lit(0.0) if constant is None else constant
    users = _as_users(_entity_rows(params, distinct_values(train, "user_id"), "user_id", tr.user_key()), constant)
    items = _as_items(_entity_rows(params, distinct_values(train, "item_id"), "item_id", tr.item_key()))
    return blocked_topn(users, items, train, item_names(train), n)


def triples(train: DataFrame, steps: range, seed: int) -> DataFrame:
    """user_id, item_id, step, negative: each train row once a step, with one uniformly drawn item.

    Rows of a repeated pair draw on their own; a draw that hits an item the user knows is left out.
    """
    index = materialize(dense_index(train, "item_id"), "index")
    total = index.agg(F.count("*")).scalar()
    rows = numbered(train.groupBy("user_id", "item_id").agg(F.count("*").alias("n")), F.col("n"), "copy")
    rows = rows.select("user_id", "item_id", "copy", F.explode(F.sequence(F.lit(steps[0]), F.lit(steps[-1]))).alias("step"))
    drawn = rows.withColumn("idx", draw(F.col("user_id"), F.col("item_id"), F.col("copy"), F.col("step"), seed) % total)
    others = index.select("idx", F.col("item_id").alias("negative"))
    known = train.select("user_id", F.col("item_id").alias("negative")).distinct()
    return drawn.join(others, "idx").join(known, ["user_id", "negative"], "left_anti").select(
        "user_id", "item_id", "step", "negative")


def bpr(train: DataFrame, k: int = BPR["k"], iters: int = BPR["iters"], lr: float = BPR["lr"],
        reg: float = BPR["reg"], seed: int = 42, chunk_rows: int = tr.CHUNK_ROWS) -> DataFrame:
    """key, vec ([bias, factors...]) under the pairwise objective; every iteration has its own negatives.

    Every train row takes part once an iteration, repeated ones too. Biases of users stay zero: they
    cancel out of every comparison.
    """
    train = materialize(train.select("user_id", "item_id"), "rows")
    ends = train.select(F.explode(F.array(tr.user_key(), tr.item_key())).alias("key"))
    params = materialize(tr.initial_rows(ends, k, 1.0 / k, seed), "params")
    keys = F.array(tr.user_key(), tr.item_key(), tr.item_key("negative"))
    for first in range(0, iters, AHEAD):
        ahead = range(first, min(first + AHEAD, iters))
        rows = triples(train, ahead, seed).select("user_id", "item_id", "step", keys.alias("keys"), F.lit(1.0).alias("y"))
        examples = tr.stored_examples(rows, chunk_rows)
        for step in ahead:
            params = materialize(tr.damped_step(examples, step, params, tr.pairwise_gradient, lr, reg), "params")
    return params


def biased_mf_lists(train: DataFrame, n: int = TOP_N, **settings) -> DataFrame:
    return factor_lists(biased_mf(train, **settings), train, global_mean(train).scalar(), n)


def bpr_lists(train: DataFrame, n: int = TOP_N, **settings) -> DataFrame:
    return factor_lists(bpr(train, **settings), train, None, n)
