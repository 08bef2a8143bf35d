"""Click models over six categorical fields: features, crosses, factor and wide models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_bucket, dot, star_bucket
from ..functions.scalars import BUCKET_SLOTS as SLOTS
from ..session import materialize
from . import training as tr
from .blocks import Extra, blocked_topn
from .logs import dense_index, item_names
from .toplists import TOP_N

# Fixed values: (user field, item field) of the crosses; the id x id cross is left out.
CROSSES = ((0, 1), (0, 2), (1, 1), (2, 2))
# Factor size, spread of the first factors, hidden layers.
FM_FACTORS, FM_STD = 16, 0.01
HIDDEN = (128, 64)
# Users and items of one block of the deep model, and hidden values held at a time inside it.
DEEP_BLOCK, NETWORK_CELLS = 1024, 2_000_000
# Passes over the examples, and the rate that each number's accumulated squares scale down.
EPOCHS, RATE = 10, 0.1
DEEP_EPOCHS, DEEP_RATE = 15, 0.003
# Decay of the network's running moments.
MOMENTS = (0.9, 0.999)
# Decimals of a mean gradient, and groups of tasks whose sums reach the driver.
DIGITS, SUM_GROUPS = 12, 16
BIAS = "bias"
USER_FIELDS, ITEM_FIELDS = ("u0", "u1", "u2"), ("i0", "i1", "i2")


def _fields(fit: DataFrame, index: DataFrame, col: str, names: tuple[str, ...]) -> DataFrame:
    stats = fit.groupBy(col).agg(F.count("*").alias("_n"), F.avg("rating").alias("_m"))
    mu = fit.agg(F.avg("rating")).scalar()
    return index.join(stats, col, "left").select(
        col, F.col("idx").cast("bigint").alias(names[0]),
        count_bucket(F.coalesce("_n", F.lit(0))).alias(names[1]), star_bucket(F.col("_m"), mu).alias(names[2]))


def user_fields(fit: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, u0 (index), u1 (activity bucket), u2 (star bucket), from the fit split only."""
    return _fields(fit, dense_index(users, "user_id"), "user_id", USER_FIELDS)


def item_fields(fit: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, i0 (index), i1 (popularity bucket), i2 (star bucket), from the fit split only."""
    return _fields(fit, dense_index(items, "item_id"), "item_id", ITEM_FIELDS)


def offsets(cards: list) -> list:
    """Start of each field when fields of the given sizes share one vocabulary."""
    return [reduce(lambda a, b: a + b, cards[:i], F.lit(0)) for i in range(len(cards))]


def cardinalities(users: DataFrame, items: DataFrame) -> list[Column]:
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    return [count(users), F.lit(SLOTS), F.lit(SLOTS), count(items), F.lit(SLOTS), F.lit(SLOTS)]


def field_offsets(users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The field rows with ids in one non-overlapping vocabulary."""
    starts = offsets(cardinalities(users, items))
    shifted = [df.withColumns({f: (F.col(f) + starts[base + j]).cast("bigint") for j, f in enumerate(fields)})
               for df, fields, base in ((users, USER_FIELDS, 0), (items, ITEM_FIELDS, 3))]
    return shifted[0], shifted[1]


def cross_ids(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, item_id, x0..x3: ids of the crosses a * card(b) + b in one shared vocabulary."""
    cards = cardinalities(users, items)
    sizes = [cards[a] * cards[3 + b] for a, b in CROSSES]
    starts = offsets(sizes)
    rows = pairs.select("user_id", "item_id").join(users, "user_id").join(items, "item_id")
    return rows.select("user_id", "item_id", *[
        (F.col(USER_FIELDS[a]) * cards[3 + b] + F.col(ITEM_FIELDS[b]) + starts[j]).cast("bigint").alias(f"x{j}")
        for j, (a, b) in enumerate(CROSSES)])


# ---- fitted models -----------------------------------------------------------------

def _tag(name: str, *cols: Column) -> Column:
    return F.concat(F.lit(name + ":"), F.concat_ws("|", *[c.cast("string") for c in cols]))


def _keys(names: tuple[str, ...]) -> list[Column]:
    return [_tag(f, F.col(f)) for f in names]


def _cross_keys() -> list[Column]:
    return [_tag(f"x{j}", F.col(USER_FIELDS[a]), F.col(ITEM_FIELDS[b])) for j, (a, b) in enumerate(CROSSES)]


def _fit(examples: DataFrame, keys: list[Column], factors: int, epochs: int, lr: float, reg: float, seed: int,
         chunk_rows: int) -> DataFrame:
    """``examples``: user_id, item_id, label and the six fields."""
    whole = F.array(F.lit(BIAS), *keys)
    rows = examples.select("user_id", "item_id", whole.alias("keys"), F.col("label").alias("y"),
                           tr.stratum(F.col("user_id"), F.col("item_id")).alias("step"))
    rows = tr.stored_examples(rows, chunk_rows)
    params = tr.initial_rows(rows.needs, factors, FM_STD, seed)
    zero = F.transform("vec", lambda x: F.lit(0.0))              # the bias has no factors
    params = materialize(params.select("key", F.when(F.col("key") == BIAS, zero).otherwise(F.col("vec")).alias("vec"),
                                       zero.alias("acc")), "params")
    for _ in range(epochs):
        for step in range(tr.STRATA):
            params = materialize(tr.scaled_step(rows, step, params, tr.logistic_gradient, lr, reg), "params")
    return params.select("key", "vec")


def with_fields(examples: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return examples.join(users, "user_id").join(items, "item_id")


def fm_fit(examples: DataFrame, factors: int = FM_FACTORS, epochs: int = EPOCHS, lr: float = RATE, reg: float = 1e-6,
           seed: int = 42, chunk_rows: int = tr.CHUNK_ROWS) -> DataFrame:
    """key, vec ([weight, factors...]) of the factorisation machine over the six fields."""
    return _fit(examples, _keys(USER_FIELDS + ITEM_FIELDS), factors, epochs, lr, reg, seed, chunk_rows)


def wide_fit(examples: DataFrame, epochs: int = EPOCHS, lr: float = RATE, reg: float = 1e-6, seed: int = 42,
             chunk_rows: int = tr.CHUNK_ROWS) -> DataFrame:
    """key, vec ([weight]) of the linear model over the six fields and the four crosses."""
    return _fit(examples, _keys(USER_FIELDS + ITEM_FIELDS) + _cross_keys(), 0, epochs, lr, reg, seed, chunk_rows)


def _side(rows: DataFrame, col: str, names: tuple[str, ...], params: DataFrame) -> DataFrame:
    """id, e0..e2: the parameter rows of one side's three fields; unknown values are zero."""
    out = rows
    width = params.select(F.max(F.size("vec"))).scalar()
    for j, f in enumerate(names):
        p = params.select(F.col("key").alias(f"_k{j}"), F.col("vec").alias(f"e{j}"))
        out = out.withColumn(f"_k{j}", _tag(f, F.col(f))).join(p, f"_k{j}", "left").withColumn(
            f"e{j}", F.coalesce(f"e{j}", F.array_repeat(F.lit(0.0), width)))
    return out.select(col, *names, "e0", "e1", "e2")


def _collapsed(side: DataFrame, col: str) -> DataFrame:
    """id, c, s: a side's constant (weights and inner products among its fields) and vector sum."""
    total = F.zip_with(F.zip_with("e0", "e1", lambda a, b: a + b), "e2", lambda a, b: a + b)
    tail = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    rows = side.withColumn("t", total)

    def squares(e: str) -> Column:
        v = F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0)))
        return dot(v, v)

    inner = 0.5 * (dot(tail, tail) - squares("e0") - squares("e1") - squares("e2"))
    return rows.select(col, (F.element_at("t", 1) + inner).alias("c"), tail.alias("s"))


def _bias(params: DataFrame) -> Column:
    return params.where("key = 'bias'").select(F.element_at("vec", 1)).scalar()


def fm_sides(params: DataFrame, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The six-field machine as one vector per user and item: users (user_id, vecs), items
    (item_id, bias, vec). Terms within one side are constants of that side."""
    u = _collapsed(_side(users, "user_id", USER_FIELDS, params), "user_id")
    i = _collapsed(_side(items, "item_id", ITEM_FIELDS, params), "item_id")
    return (u.select("user_id", F.array(F.concat(F.array(F.col("c") + _bias(params)), "s")).alias("vecs")),
            i.select("item_id", F.col("c").alias("bias"), F.concat(F.array(F.lit(1.0)), "s").alias("vec")))


def wide_sides(params: DataFrame, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The linear model in the same form: item fields in the crosses are only buckets, so a
    user's crosses are one weight per item bucket and an item is a pair of bucket indicators."""
    u = _collapsed(_side(users, "user_id", USER_FIELDS, params), "user_id").select("user_id", "c")
    i = _collapsed(_side(items, "item_id", ITEM_FIELDS, params), "item_id").select("item_id", "c")
    cells = []
    for j, (a, b) in enumerate(CROSSES):
        for slot in range(SLOTS):
            cells.append(F.struct(F.lit((b - 1) * SLOTS + slot).alias("dim"),
                                  _tag(f"x{j}", F.col(USER_FIELDS[a]), F.lit(slot)).alias("key")))
    weights = (users.select("user_id", F.explode(F.array(*cells)).alias("_c"))
               .select("user_id", "_c.dim", "_c.key").join(params, "key", "left")
               .groupBy("user_id", "dim").agg(F.sum(F.coalesce(F.element_at("vec", 1), F.lit(0.0))).alias("w"))
               .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("dim", "w"))).alias("_e")))   # 24 entries
    vecs = F.concat(F.array(F.col("c") + _bias(params)), F.transform("_e", lambda e: e["w"]))

    def indicator(col: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: (s == F.col(col)).cast("double"))

    hot = F.concat(F.array(F.lit(1.0)), indicator("i1"), indicator("i2"))
    return (weights.join(u, "user_id").select("user_id", F.array(vecs).alias("vecs")),
            items.join(i, "item_id").select("item_id", F.col("c").alias("bias"), hot.alias("vec")))


def ranker_lists(sides: tuple[DataFrame, DataFrame], train: DataFrame, n: int = TOP_N) -> DataFrame:
    """Lists over all items of a model in (users, items) vector form."""
    return blocked_topn(sides[0], sides[1], train, item_names(train), n)


def pair_scores(sides: tuple[DataFrame, DataFrame], pairs: DataFrame) -> DataFrame:
    """user_id, item_id, score of given pairs under a model in vector form."""
    return (pairs.select("user_id", "item_id").join(sides[0], "user_id").join(sides[1], "item_id")
            .select("user_id", "item_id", (F.col("bias") + dot(F.element_at("vecs", 1), F.col("vec"))).alias("score")))


# ---- deep part ---------------------------------------------------------------------

def _factors(rows: DataFrame, col: str, names: tuple[str, ...], params: DataFrame) -> DataFrame:
    """id, extra: the factor vectors of one side's three fields side by side."""
    parts = [F.slice(f"e{j}", 2, F.size(f"e{j}") - 1) for j in range(3)]
    return _side(rows, col, names, params).select(col, F.concat(*parts).alias("extra"))


def deep_inputs(pairs: DataFrame, params: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with ``features``: the factor vectors of their six fields side by side."""
    u = _factors(users, "user_id", USER_FIELDS, params).withColumnRenamed("extra", "_u")
    i = _factors(items, "item_id", ITEM_FIELDS, params).withColumnRenamed("extra", "_i")
    return pairs.join(u, "user_id").join(i, "item_id").withColumn("features", F.concat("_u", "_i")).drop("_u", "_i")


Layers = list[tuple[np.ndarray, np.ndarray]]


def first_layers(widths: tuple[int, ...], seed: int) -> Layers:
    """(weights, intercepts) of each layer, uniform within one over the root of its inputs."""
    rng = np.random.default_rng(seed)
    return [tuple(rng.uniform(-n ** -0.5, n ** -0.5, size) for size in ((n, m), (m,))) for n, m in zip(widths, widths[1:])]


def network_gradient(layers: Layers, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Downhill direction of the summed log loss, for each weight matrix and intercept in turn."""
    values = [x]
    for w, b in layers[:-1]:
        values.append(np.maximum(values[-1] @ w + b, 0.0))
    logit = (values[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
    back, out = (y - 1.0 / (1.0 + np.exp(-logit)))[:, None], []
    for (w, _), v in zip(reversed(layers), reversed(values)):
        out = [v.T @ back, back.sum(axis=0), *out]
        back = (back @ w.T) * (v > 0)
    return out


def deep_fit(inputs: DataFrame, factors: int = FM_FACTORS, hidden: tuple[int, ...] = HIDDEN, epochs: int = DEEP_EPOCHS,
             lr: float = DEEP_RATE, seed: int = 42) -> Layers:
    """A network with rectified hidden layers on ``features`` (user_id, item_id, features, label).

    A step sums the gradient over all rows that a digest deals to it, and moves the weights by their mean
    and its running moments. Means are rounded, so that the order of a sum does not show: the layers
    depend neither on partitions nor on the order of rows. What comes to the driver is one sum a step,
    as large as the layers.
    """
    rows = materialize(inputs.select("features", F.col("label").cast("double").alias("label"),
                                     tr.stratum(F.col("user_id"), F.col("item_id")).alias("step")), "inputs")
    layers = first_layers((6 * factors, *hidden, 1), seed)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for layer in layers for p in layer]
    done = 0
    for _ in range(epochs):
        for step in range(tr.STRATA):
            total, n = _network_sums(rows.where(f"step = {step}").select("features", "label"), layers)
            if not n:
                continue
            done += 1
            flat = [p for layer in layers for p in layer]
            at, new = 0, []
            for p, (m, v) in zip(flat, moments):
                g = np.round(total[at:at + p.size].reshape(p.shape) / n, DIGITS)
                at += p.size
                m += (1 - MOMENTS[0]) * (g - m)
                v += (1 - MOMENTS[1]) * (g * g - v)
                new.append(p + lr * (m / (1 - MOMENTS[0] ** done)) / (np.sqrt(v / (1 - MOMENTS[1] ** done)) + tr.LEAST))
            layers = list(zip(new[::2], new[1::2]))
    return layers


def _network_sums(rows: DataFrame, layers: Layers) -> tuple[np.ndarray, int]:
    """The summed gradient of all weights over the rows, and how many rows there are."""
    def run(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                part = np.concatenate([g.ravel() for g in network_gradient(layers, x, batch.column(1).to_numpy())])
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["g", "n"])

    parts = rows.mapInArrow(run, "g array<double>, n bigint").select(array_to_vector("g").alias("g"), "n")
    # tasks meet in groups first, so that no task adds up the sums of all others
    groups = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)).alias("k")).agg(Summarizer.sum(F.col("g")).alias("g"), F.sum("n").alias("n"))
    found = groups.collect()                                     # at most SUM_GROUPS rows as large as the layers
    return (np.sum([r["g"].toArray() for r in sorted(found, key=lambda r: r["k"])], axis=0) if found else np.empty(0),
            sum(r["n"] for r in found))


def network_scores(layers: Layers, cells: int = NETWORK_CELLS) -> Extra:
    """Adds the network's logit for every (user, item) of a block.

    The first layer is linear in the two sides' inputs, so each side is multiplied once; only its sum,
    the rectifier and the smaller layers are per pair, for ``cells`` hidden values at a time.
    """
    (first, first_b), *hidden, (last, last_b) = layers

    def add(scores: np.ndarray, users: np.ndarray, items: np.ndarray) -> None:
        left = users @ first[:users.shape[1]] + first_b
        right = items @ first[users.shape[1]:]
        step = max(1, cells // max(1, right.size))
        for s in range(0, len(left), step):
            x = np.maximum(left[s:s + step, None, :] + right[None, :, :], 0.0)
            for w, b in hidden:
                x = np.maximum(x @ w + b, 0.0)
            scores[s:s + step] += (x @ last)[:, :, 0] + last_b[0]

    return add


def deep_lists(layers: Layers, base: tuple[DataFrame, DataFrame], params: DataFrame, users: DataFrame, items: DataFrame,
               train: DataFrame, n: int = TOP_N, block: int = DEEP_BLOCK) -> DataFrame:
    """Lists over all items by base score + network logit; every unseen (user, item) is scored."""
    u = base[0].join(_factors(users, "user_id", USER_FIELDS, params), "user_id")
    i = base[1].join(_factors(items, "item_id", ITEM_FIELDS, params), "item_id")
    return blocked_topn(u, i, train, item_names(train), n, block=block, extra=network_scores(layers))
