"""Distributed fitting of models with one parameter row per user, item or feature value.

Parameters are a table (key, vec), never a driver-side matrix. A step takes the examples that a digest
deals to it, sums the gradient of every key over all of them, and moves each key once. What a step does
is a sum over rows, so the model depends neither on how rows are dealt into tasks nor on how many there
are; an SQL statement can take the same steps. Chunks only bound what a task holds: each is joined with
the parameter rows it needs, and its gradients are partial sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, key_digest
from ..session import materialize
from .spread import spread_out

# Examples of one chunk: bounds a task, changes no result.
CHUNK_ROWS = 16_384
# Fixed value: strata of users and of items. A pass takes each (user stratum, item stratum) once.
STRATA = 2

# Added to the root of the accumulated squares, so that sums that cancel out move nothing.
LEAST = 1e-8

# (parameter rows, fields of each example, targets) -> gradient of each field's row, by example
Gradient = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def with_chunks(examples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``chunk``: a user's examples share a chunk unless they exceed ``chunk_rows``."""
    counts = examples.groupBy("user_id").agg(F.count("*").alias("_n"))
    heavy = counts.where(F.col("_n") > chunk_rows)
    n = F.ceil(examples.agg(F.count("*")).scalar() / chunk_rows)
    pieces = F.coalesce(F.ceil(F.col("_n") / chunk_rows), F.lit(1))
    piece = F.pmod(F.xxhash64("item_id"), pieces)
    return (examples.join(heavy, "user_id", "left")
            .withColumn("chunk", F.pmod(F.xxhash64("user_id", piece), n)).drop("_n"))


def stratum(user: Column, item: Column, strata: int = STRATA) -> Column:
    """The step of a pass that takes a pair: in step s, user stratum a meets item stratum a + s."""
    return F.pmod(draw(F.lit("i"), item) - draw(F.lit("u"), user), F.lit(strata)).cast("int")


def gaussian(key: Column, dim: Column, seed: int) -> Column:
    """Standard normal value made from a key, by the Box-Muller transform of two draws."""
    digest = key_digest(key, dim, seed)

    def uniform(i: int) -> Column:
        return (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") + 0.5) / 2.0 ** 32

    return F.sqrt(-2.0 * F.log(uniform(0))) * F.cos(2.0 * np.pi * uniform(1))


def initial_rows(keys: DataFrame, factors: int, std: float, seed: int) -> DataFrame:
    """key, vec: a zero bias and ``factors`` normal values per key."""
    vec = F.array(F.lit(0.0))
    if factors:
        vec = F.concat(vec, F.transform(F.sequence(F.lit(1), F.lit(factors)),
                                        lambda d: gaussian(F.col("key"), d, seed) * std))
    return keys.select("key").distinct().select("key", vec.alias("vec"))


@dataclass(frozen=True)
class Examples:
    """Stored examples: ``chunks`` (step, chunk, fields, y), one row a chunk, whose fields are places among
    the chunk's keys; ``needs`` (step, chunk, place, key)."""

    chunks: DataFrame
    needs: DataFrame


def stored_examples(examples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Examples:
    """``examples``: user_id, item_id, step, keys (an array of one length), y."""
    dealt = with_chunks(examples, chunk_rows).select("step", "chunk", "keys", F.col("y").cast("double").alias("y"))
    schema = "step int, chunk bigint, keys array<string>, fields binary, y binary"
    names = ["step", "chunk", "keys", "fields", "y"]

    def packed(rows: pa.Table) -> pa.Table:
        lists = rows["keys"].combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        return pa.table([rows["step"].combine_chunks().slice(0, 1), rows["chunk"].combine_chunks().slice(0, 1),
                         pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                         pa.array([coded.indices.to_numpy().astype("<i4").tobytes()], pa.binary()),
                         pa.array([rows["y"].to_numpy().astype("<f8").tobytes()], pa.binary())], names)

    stored = materialize(spread_out(dealt, ["step", "chunk"]).groupBy("step", "chunk").applyInArrow(packed, schema), "examples")
    needs = materialize(stored.select("step", "chunk", F.posexplode("keys").alias("place", "key")), "needs")
    return Examples(stored.select("step", "chunk", "fields", "y"), needs)


def _partial(gradient: Gradient):
    def run(examples: pa.Table, params: pa.Table) -> pa.Table:
        place = params["place"].to_numpy()
        width = len(params["vec"][0]) if len(place) else 0
        flat = params["vec"].combine_chunks().flatten().to_numpy().reshape(len(place), width)
        table = np.empty_like(flat)
        table[place] = flat
        y = np.frombuffer(examples["y"][0].as_py(), "<f8") if examples.num_rows else np.empty(0)
        fields = np.frombuffer(examples["fields"][0].as_py(), "<i4").reshape(len(y), -1) if len(y) else np.empty((0, 1), int)
        total, uses = np.zeros_like(table), np.bincount(fields.ravel(), minlength=len(table)).astype(float)
        if len(y):
            grad = gradient(table, fields, y)
            for c in range(fields.shape[1]):
                order = np.argsort(fields[:, c], kind="stable")
                ids = fields[order, c]
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                total[ids[starts]] += np.add.reduceat(grad[order, c], starts, axis=0)
        rows = total[place]
        ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * width)
        return pa.table([params["key"].combine_chunks(), pa.ListArray.from_arrays(ends, pa.array(rows.ravel())),
                         pa.array(uses[place])], ["key", "grad", "uses"])

    return run


def gradients(examples: Examples, step: int, params: DataFrame, gradient: Gradient) -> DataFrame:
    """The parameter rows with ``grad`` and ``uses``: the summed gradient of each key in a step's examples,
    and how often it occurs there (null for keys that do not).

    Rows and partial sums meet in one aggregate, so a step moves the parameters once to the chunks and
    once to their keys.
    """
    rows = examples.chunks.where(f"step = {step}")
    needs = (examples.needs.where(f"step = {step}").selectExpr("chunk AS need", "place", "key")
             .join(params.select("key", "vec"), "key"))
    parts = spread_out(rows, ["chunk"]).groupBy("chunk").cogroup(spread_out(needs, ["need"]).groupBy("need")).applyInArrow(
        _partial(gradient), "key string, grad array<double>, uses double")
    own = [c for c in params.columns if c != "key"]
    rest = params.selectExpr("key", "transform(vec, v -> 0.0D) AS grad", "CAST(NULL AS DOUBLE) AS uses", *own)
    both = parts.unionByName(rest, allowMissingColumns=True)
    met = both.groupBy("key").agg(Summarizer.sum(array_to_vector("grad")).alias("_v"), F.sum("uses").alias("uses"),
                                  *[F.max(c).alias(c) for c in own])          # one row a key
    return met.select("key", *own, vector_to_array("_v").alias("grad"), "uses")


def damped_step(examples: Examples, step: int, params: DataFrame, gradient: Gradient, lr: float, reg: float) -> DataFrame:
    """params after one step: a key with n examples moves as far as n small steps would take it.

    n steps of rate ``lr`` in a row leave the share (1 - lr)^n of a key's distance to its optimum if all
    else stands still; so the summed gradient counts with (1 - (1 - lr)^n) / n. This is ``lr`` for rare
    keys, and it keeps keys with a third of all rows from overshooting.
    """
    rate = f"((1.0D - pow({1.0 - lr!r}D, uses)) / uses)"
    moved = f"zip_with(vec, grad, (v, g) -> v + {rate} * (g - uses * {reg!r}D * v))"
    return gradients(examples, step, params, gradient).selectExpr("key", f"if(uses IS NULL, vec, {moved}) AS vec")


def scaled_step(examples: Examples, step: int, params: DataFrame, gradient: Gradient, lr: float, reg: float) -> DataFrame:
    """params (key, vec, acc) after one step of the mean gradient, scaled by each number's accumulated squares."""
    rows = gradients(examples, step, params, gradient).selectExpr(
        "key", "uses", "vec", "acc", f"zip_with(vec, grad, (v, g) -> g / uses - {reg!r}D * v) AS g")
    rows = rows.selectExpr("key", "uses", "vec", "g", "if(uses IS NULL, acc, zip_with(acc, g, (a, x) -> a + x * x)) AS acc")
    moves = f"zip_with(g, acc, (x, a) -> {lr!r}D * x / (sqrt(a) + {LEAST!r}D))"
    return rows.selectExpr("key", f"if(uses IS NULL, vec, zip_with(vec, {moves}, (v, m) -> v + m)) AS vec", "acc")


def user_key() -> Column:
    return F.concat(F.lit("u:"), F.col("user_id").cast("string"))


def item_key(name: str = "item_id") -> Column:
    return F.concat(F.lit("i:"), F.col(name).cast("string"))


def squared_gradient(mu: float) -> Gradient:
    """Downhill direction of the squared loss of mu + b_u + b_i + p.q; fields are (user, item)."""
    def grad(table: np.ndarray, fields: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = table[fields]                                        # examples x 2 x (1 + factors)
        err = y - (mu + x[:, 0, 0] + x[:, 1, 0] + np.einsum("ij,ij->i", x[:, 0, 1:], x[:, 1, 1:]))
        out = x[:, ::-1] * err[:, None, None]
        out[:, :, 0] = err[:, None]
        return out
    return grad


def pairwise_gradient(table: np.ndarray, fields: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Uphill direction of ln sigma(x_ui - x_uj); fields are (user, item, other item)."""
    u, i, j = (table[fields[:, c]] for c in range(3))
    gap = i[:, 0] - j[:, 0] + np.einsum("ij,ij->i", u[:, 1:], i[:, 1:] - j[:, 1:])
    z = (1.0 / (1.0 + np.exp(gap)))[:, None]
    out = np.stack([z * (i - j), z * u, -z * u], axis=1)
    out[:, 0, 0] = 0.0
    out[:, 1, 0], out[:, 2, 0] = z[:, 0], -z[:, 0]
    return out


def logistic_gradient(table: np.ndarray, fields: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Downhill direction of the log loss of the sum of weights plus all pairwise vector products.

    The first field is the bias: it has a weight only.
    """
    x = table[fields]                                            # examples x fields x (1 + factors)
    total = x[:, :, 1:].sum(axis=1)
    pair = 0.5 * ((total ** 2).sum(axis=1) - (x[:, :, 1:] ** 2).sum(axis=(1, 2)))
    err = y - 1.0 / (1.0 + np.exp(-(x[:, :, 0].sum(axis=1) + pair)))
    out = np.empty_like(x)
    out[:, :, 0] = err[:, None]
    out[:, :, 1:] = err[:, None, None] * (total[:, None, :] - x[:, :, 1:])
    out[:, 0, 1:] = 0.0
    return out
