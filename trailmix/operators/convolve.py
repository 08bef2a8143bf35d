"""Neighbourhood convolutions as table jobs: node map, join, weighted sum, node map.

Layer weights are small matrices (their size depends on the layer widths only) and travel
with the tasks; node states are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Layer widths and number of layers.
DIM, HIDDEN, LAYERS = 128, 256, 2
TINY = 1e-12


def seeded_weights(d_in: int, dim: int = DIM, hidden: int = HIDDEN, layers: int = LAYERS,
                   seed: int = 42) -> dict:
    """Random weights of all layers and of the head, for data jobs without a trained model."""
    rng = np.random.default_rng(seed)

    def linear(rows: int, cols: int):
        bound = 1.0 / np.sqrt(cols)
        return rng.uniform(-bound, bound, (rows, cols)), rng.uniform(-bound, bound, rows)

    convs, width = [], d_in
    for _ in range(layers):
        (q, qb), (w, wb) = linear(hidden, width), linear(dim, width + hidden)
        convs.append({"Q": q, "q": qb, "W": w, "w": wb})
        width = dim
    g1, g1b = linear(dim, dim)
    g2, _ = linear(dim, dim)
    return {"convs": convs, "G1": g1, "g": g1b, "G2": g2}


def weighted_vector_sum(vectors: DataFrame, nbr: DataFrame, pool: str = "importance") -> DataFrame:
    """src, n: pooled vectors of the neighbours (``vectors``: node, vec; ``nbr``: src, dst, alpha).

    importance: weighted mean by alpha; mean: plain mean where alpha > 0; max: maximum
    where alpha > 0. The pooling is a partial aggregate, so rows combine before the shuffle.
    """
    if pool not in ("importance", "mean", "max"):
        raise ValueError(f"unknown pooling {pool}")
    weight = F.col("alpha") if pool == "importance" else F.lit(1.0)
    rows = (nbr.where(F.col("alpha") > 0).select("src", F.col("dst").alias("node"), weight.alias("w"))
            .join(vectors, "node").select("src", "w", array_to_vector("vec").alias("v")))
    metric = Summarizer.max if pool == "max" else Summarizer.mean
    return rows.groupBy("src").agg(metric(F.col("v"), F.col("w")).alias("v")).select(
        "src", vector_to_array("v").alias("n"))


def _map_vectors(df: DataFrame, schema: str, fn) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield fn(pdf)

    return df.mapInPandas(batches, schema)


def _unit(z: np.ndarray) -> list:
    return list(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), TINY))


def _node_type(h: DataFrame) -> str:
    return h.schema["node"].dataType.simpleString()


def convolve(h: DataFrame, nbr: DataFrame, layer: dict, pool: str = "importance") -> DataFrame:
    """One convolution over ``h`` (node, vec): each node is computed once."""
    q, qb, w, wb = (np.asarray(layer[k], dtype=float) for k in ("Q", "q", "W", "w"))
    hidden = q.shape[0]

    def message(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.maximum(np.stack(pdf["vec"]) @ q.T + qb, 0.0)
        return pd.DataFrame({"node": pdf["node"], "vec": list(m)})

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.stack(pdf["vec"]), np.stack(pdf["n"])], axis=1)
        return pd.DataFrame({"node": pdf["node"], "vec": _unit(np.maximum(x @ w.T + wb, 0.0))})

    schema = f"node {_node_type(h)}, vec array<double>"
    pooled = weighted_vector_sum(_map_vectors(h, schema, message), nbr, pool)
    zero = F.array_repeat(F.lit(0.0), hidden)
    both = h.join(pooled.withColumnRenamed("src", "node"), "node", "left").select(
        "node", "vec", F.coalesce("n", zero).alias("n"))
    return _map_vectors(both, schema, update)


def embed_catalog(content: DataFrame, nbr: DataFrame, weights: dict, pool: str = "importance") -> DataFrame:
    """item_id, vec: unit vectors of the whole catalog; every layer runs once per node."""
    h = content.select(F.col("item_id").alias("node"), "vec")
    for layer in weights["convs"]:
        h = materialize(convolve(h, nbr, layer, pool), "layer")
    g1, g, g2 = (np.asarray(weights[k], dtype=float) for k in ("G1", "g", "G2"))

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.maximum(np.stack(pdf["vec"]) @ g1.T + g, 0.0) @ g2.T
        return pd.DataFrame({"node": pdf["node"], "vec": _unit(z)})

    out = _map_vectors(h, f"node {_node_type(h)}, vec array<double>", head)
    return out.select(F.col("node").alias("item_id"), "vec")
