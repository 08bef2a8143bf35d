"""Quality rules: counted rules first, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples

# Rule limits: fewest words, and the highest share of words in repeated 8-word windows, in percent.
FEWEST, REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What the trees see, and the direction in which each may move the verdict (-1: more is never better).
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "capitals": -1,
            "digits": 0, "distinct": 0, "line_words": 0, "marks": 0}
SAMPLE = 4000               # labelled documents of each verdict that the trees are fitted on
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
BASE = 0x9E3779B97F4A7C15 | 3        # odd, so it has an inverse modulo 2**64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            values = np.full(m, base, np.uint64)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` codes: a difference of prefix sums, shifted to a common base."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    up, down = powers(len(codes))
    sums = np.cumsum(codes * up, dtype=np.uint64)
    runs = sums[width - 1:].copy()
    runs[1:] -= sums[:-width]
    return runs * down[:len(runs)]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts`` (ascending, distinct)."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated_words(words: list[bytes]) -> int:
    runs = window_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), WINDOW)
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, runs), len(twice) - 1)
    return int(covered(np.flatnonzero(twice[at] == runs), WINDOW, len(words)).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of the contract and the features of one whole text (UTF-8)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, chars = len(words), int(by_byte[:128].sum() + by_byte[192:].sum() - by_byte[list(SPACES)].sum())
    symbols, dup, repeat = int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)
    capitals, small = by_byte[65:91].sum(), by_byte[97:123].sum()
    one = max(1, n)
    return [n, chars, symbols, dup, repeat], [
        np.log1p(n), chars / one, symbols / max(1, chars), dup / max(1, len(lines)), repeat / one,
        capitals / max(1, capitals + small), by_byte[48:58].sum() / max(1, chars), len(set(words)) / one,
        np.log1p(n / max(1, len(lines))), by_byte[33] / one]


@dataclass(frozen=True)
class Trees:
    """All trees as node arrays: a leaf points to itself. ``start`` holds the roots."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Every row goes down every tree at once, one level a step."""
        node = np.broadcast_to(self.start, (len(x), len(self.start)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 48, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for a 0/1 target on binned features, with monotonic constraints.

    A split on a constrained feature must order its two leaf values the right way, and both sides are
    bounded by the middle of the two further down, so the whole sum is monotone in that feature.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    mean = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []            # feature, limit, left, right, value
    start = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + penalty), low, high))

    def grow(rows, g, h, low, high, level) -> int:
        here, total = len(nodes), (g[rows].sum(), h[rows].sum())
        nodes.append([0, 0.0, here, here, rate * leaf(*total, low, high)])
        best = (1e-6, None)
        for f, edge in enumerate(edges if level < depth else []):
            gs, hs = (np.cumsum(np.bincount(codes[rows, f], v[rows], len(edge) + 1))[:-1] for v in (g, h))
            gr, hr = total[0] - gs, total[1] - hs
            a, b = np.clip(-gs / (hs + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
            gain = gs**2 / (hs + penalty) + gr**2 / (hr + penalty) - total[0]**2 / (total[1] + penalty)
            ok = (hs * 4 >= least) & (hr * 4 >= least) & (signs[f] * (b - a) >= 0)
            if ok.any() and (k := int(np.argmax(np.where(ok, gain, -1)))) >= 0 and gain[k] > best[0]:
                best = (gain[k], (f, k, (a[k] + b[k]) / 2))
        if best[1]:
            f, k, middle = best[1]
            goes = codes[rows, f] <= k
            bounds = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] else ((low, high),) * 2
            nodes[here][:2] = [f, float(edges[f][k])]
            nodes[here][2] = grow(rows[goes], g, h, *bounds[0], level + 1)
            nodes[here][3] = grow(rows[~goes], g, h, *bounds[1], level + 1)
        else:
            nodes[here][1] = np.inf
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        start.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
        at = np.full(len(y), start[-1])
        table = np.array(nodes)
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), table[at, 0].astype(int)] <= table[at, 1], table[at, 2], table[at, 3]).astype(int)
        score += table[at, 4]
    table = np.array(nodes).reshape(-1, 5)
    return Trees(table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32),
                 table[:, 4], np.array(start, np.int32), depth, base)


def measured(docs: DataFrame, trees: Trees | None, columns: list[str], least: float) -> DataFrame:
    """``columns`` of every row with the counts, the features and, given trees, the verdict."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or b"") for t in batch.column("_text").cast(pa.binary())]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            failed = (counts[:, 0] < FEWEST) | (100 * counts[:, 4] > REPEATED * counts[:, 0])
            score = np.ones(len(x)) if trees is None else trees.probability(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *map(pa.array, counts.T),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())),
                 pa.array(score), pa.array(failed), pa.array(~failed & (score >= least))],
                [*columns, *(f"_{c}" for c in COUNTS), "_features", "_score", "_failed", "_kept"])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(work, f"{kinds}, {', '.join(f'_{c} bigint' for c in COUNTS)}, _features array<double>, "
                                 "_score double, _failed boolean, _kept boolean")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on the labelled documents: at most ``sample`` of each quality on average.

    Null if the labels do not hold both verdicts; then every document passes that the rules let pass.
    """
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = samples.by_class(rows, "quality", F.col("doc_id"), sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")    # 2 x sample rows
    found = sorted(measured(known, None, ["doc_id", "quality"], 0).select("doc_id", "quality", "_features").collect())
    y = np.array([r["quality"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return None
    return fit_trees(np.array([r["_features"] for r in found]), y, list(FEATURES.values()))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, counts, base_failed, kept, score) of every document; a null text has no words and fails."""
    rows = measured(docs, fit(docs, labels, sample), ["doc_id"], least)
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_failed").alias("base_failed"),
                       F.col("_kept").alias("kept"), F.col("_score").alias("score"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return measured(whole, fit(docs, labels, sample), ["_row"], least).where("_kept").select("_row.*")
