"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples

LENGTH = 256                # bytes of a window
WIDTHS = (2, 3, 4)          # filter widths
FILTERS, DIM = 16, 8        # filters of each width, and width of a byte's vector
SAMPLE = 800                # documents of each language the network is trained on, two windows of each
_latin = re.compile(rb"[A-Za-z]").search


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zero bytes fill the last), each window's text and its bytes of text."""
    sizes = np.array([max(1, -(-len(t) // LENGTH)) for t in texts], np.int64)
    data = b"".join([t.lower() + bytes(int(n) * LENGTH - len(t)) for t, n in zip(texts, sizes, strict=True)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - first[owner]
    real = np.clip(np.array([len(t) for t in texts], np.int64)[owner] - place * LENGTH, 1, LENGTH)
    return np.frombuffer(data, np.uint8).reshape(-1, LENGTH), owner, real


@dataclass
class Network:
    """Byte vectors, one bank of filters for each width, max pooling, and a softmax layer."""

    langs: list[str]
    vectors: np.ndarray                 # 256 x DIM
    banks: list[np.ndarray]             # width x DIM x FILTERS
    bias: np.ndarray                    # widths * FILTERS
    out: np.ndarray                     # widths * FILTERS x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """A filter's answer is a sum over its bytes; two neighbouring bytes share one look-up."""
        single = [[(self.vectors @ bank[j]).astype(np.float32) for j in range(len(bank))] for bank in self.banks]
        return [[(s[j][:, None] + s[j + 1][None]).reshape(-1, FILTERS) if j + 1 < len(s) else s[j]
                 for j in range(0, len(s), 2)] for s in single]

    def probabilities(self, x: np.ndarray, tables=None, block: int = 256) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(x), len(self.langs)), np.float32)
        for k in range(0, len(x), block):
            part = x[k:k + block]
            pairs = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            pooled = []
            for width, looks in zip(WIDTHS, tables, strict=True):
                n = LENGTH - width + 1
                total = looks[0].take(pairs[:, :n], 0)
                for j, look in enumerate(looks[1:], 1):
                    total += look.take(pairs[:, 2 * j:2 * j + n] if len(look) > 256 else part[:, 2 * j:2 * j + n], 0)
                pooled.append(total.max(1))
            out[k:k + block] = softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01,
          seed: int = 7) -> Network:
    """Cross entropy, Adam; the gradient of max pooling reaches one place of a window for each filter."""
    rng = np.random.default_rng(seed)
    pooled = FILTERS * len(WIDTHS)
    net = Network(langs, rng.normal(0, 0.5, (256, DIM)), [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)) for w in WIDTHS],
                  np.zeros(pooled), rng.normal(0, pooled ** -0.5, (pooled, len(langs))), np.zeros(len(langs)))
    params = [net.vectors, *net.banks, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    target = np.eye(len(langs))[y]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            part, step, n = x[rows].astype(np.int64), step + 1, len(rows)
            best, answers = [], []
            for width, bank in zip(WIDTHS, net.banks, strict=True):
                m = LENGTH - width + 1
                total = sum((net.vectors @ bank[j]).astype(np.float32)[part[:, j:j + m]] for j in range(width))
                at = total.argmax(1)
                best.append(at)
                answers.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
            before = np.concatenate(answers, 1) + net.bias
            hidden = np.maximum(before, 0)
            error = (softmax(hidden @ net.out + net.out_bias) - target[rows]) / n
            back = (error @ net.out.T) * (before > 0)
            grads = [np.zeros_like(net.vectors)]
            for k, (width, bank) in enumerate(zip(WIDTHS, net.banks, strict=True)):
                delta, grad = back[:, k * FILTERS:(k + 1) * FILTERS], np.zeros_like(bank)
                for j in range(width):
                    seen = np.take_along_axis(part, best[k] + j, 1) * FILTERS + np.arange(FILTERS)
                    by_byte = np.bincount(seen.ravel(), delta.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    grad[j] = net.vectors.T @ by_byte
                    grads[0] += by_byte @ bank[j].T
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            for p, g, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out():
    """Documents never learned from: crc32 of the id as text leaves 1 modulo 3. A null id is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = SAMPLE) -> Network | None:
    """A network trained on about ``per_lang`` documents of each language that are not held out.

    Two windows of each document, its first and its middle one, come to the driver: at most
    2 x ``per_lang`` x 256 bytes of a language. Null if no document has a language.
    """
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = samples.by_class(rows, "lang", F.col("doc_id"), per_lang)
    middle = F.greatest(F.lit(1), F.length("text") / 2 - LENGTH / 2).cast("int")
    parts = rows.select("doc_id", "lang", F.explode(F.array(F.substring("text", 1, LENGTH), F.substr("text", middle, F.lit(LENGTH)))).alias("part"))
    found = sorted((r["lang"], r["doc_id"], r["part"]) for r in parts.collect())
    if not found:
        return None
    langs = sorted({r[0] for r in found})
    x = windows([r[2].encode()[:LENGTH] for r in found])[0]
    return train(x, np.array([langs.index(r[0]) for r in found]), langs)


def identified(docs: DataFrame, per_lang: int = SAMPLE, network: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from all windows of its whole text.

    A text's probabilities are the mean over its windows, weighted by their bytes; the first of equal
    languages in order of name wins. ``und`` with score 0 if the text is null or has no letter, or if
    no language could be learned. Repeated rows get equal rows.
    """
    net = network or fit(docs, per_lang)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("_text").cast(pa.binary())]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if _latin(t) or any(map(str.isalpha, t.decode()))] if net else []
            for k in range(0, len(known), 500):
                some = known[k:k + 500]
                x, owner, real = windows([texts[i] for i in some])
                p = net.probabilities(x, tables) * real[:, None]
                total = np.add.reduceat(p, np.flatnonzero(np.diff(owner, prepend=-1)), 0)
                total /= total.sum(1, keepdims=True)
                for i, best, value in zip(some, total.argmax(1), total.max(1), strict=True):
                    lang[i], score[i] = net.langs[best], min(1.0, float(value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
