"""How the tokens of two tokenizers lie over each other in the same bytes, and how often their ids meet.

Texts are encoded once and their links stored compactly. Most groups are one token of each tokenizer with
the same bytes; an identity map, worked out once from the vocabularies, gives the partner, and such links are
counted in vectors as long as the vocabulary. Only the links of irregular groups are counted and, if they
are rare, looked up by a shuffle on the id pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .alphabet import byte_alphabet

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT = 1_000_000        # irregular pairs whose counts travel with the tasks: 12 bytes each
BUFFERED = 2_000_000        # irregular pairs a task holds before it passes on their counts
# Fixed value: the splitting pattern of the first tokenizer's vocabulary.
SPLIT = public_tokenizers.PATTERN
SHIFT = 1 << 32


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, and the identity map between them."""

    def __init__(self, first: str, second: str):
        self.first, self.second = first, second

    def __getstate__(self):
        return {"first": self.first, "second": self.second}

    @cached_property
    def a_bytes(self) -> list[bytes]:
        with open(self.first, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_alphabet()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in letters for c in token):
                out[k] = bytes(letters[c] for c in token)
        return out

    @cached_property
    def a(self):
        """The byte-level vocabulary's ids are its merge order, which is all that the encoder needs."""
        import tiktoken

        special = self.special
        ranks = {token: k for k, token in enumerate(self.a_bytes) if token and k not in special}
        return tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def special(self) -> set[int]:
        with open(self.first, encoding="utf-8") as f:
            return {t["id"] for t in json.load(f)["added_tokens"] if t["special"]}

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.second)

    @cached_property
    def b_bytes(self) -> list[bytes]:
        pieces = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">")
                else p.replace("▁", " ").encode() for p in pieces]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))

    @cached_property
    def identity(self) -> np.ndarray:
        """For each id of the first, the id of the second with the same bytes, or -1.

        Where a piece and a byte token have the same byte, the piece is meant: encoding prefers it.
        """
        at: dict[bytes, int] = {}
        for k in sorted(range(len(self.b_bytes)), key=self.b.is_byte):
            if not (self.b.is_control(k) or self.b.is_unknown(k)):
                at.setdefault(self.b_bytes[k], k)
        return np.array([at.get(token, -1) if token else -1 for token in self.a_bytes], np.int64)

    @cached_property
    def written(self) -> list[str]:
        """Ids as text: of the first with "," and with "|", then of the second with "," and with ";"."""
        sizes = len(self.a_bytes), len(self.b_bytes)
        return [f"{k}{sign}" for n, signs in zip(sizes, (",|", ",;"), strict=True) for sign in signs for k in range(n)]

    def digest(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> str:
        """SHA-256 of the groups written as ``a1,a2|b1;a3|b2,b3``; the cuts are the groups' ends."""
        n, m = len(self.a_bytes), len(self.b_bytes)
        left, right = a.copy(), b + 2 * n
        left[a_cut - 1] += n
        right[b_cut - 1] += m
        # a stable sort by group puts each group's ids of the first before those of the second
        groups = [np.repeat(np.arange(len(cut)), np.diff(cut, prepend=0)) for cut in (a_cut, b_cut)]
        order = np.argsort(np.concatenate(groups), kind="stable")
        text = "".join(map(self.written.__getitem__, np.concatenate([left, right])[order].tolist()))
        return hashlib.sha256(text[:-1].encode()).hexdigest()

    def encoded(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none if the text is null, empty, not UTF-8, or comes back changed from either."""
        try:
            words = (text or b"").decode()
        except UnicodeDecodeError:
            words = ""
        if words:
            a, b, whole = self.a.encode_ordinary(" " + words), self.b.encode(words), b" " + text
            if all(b"".join(map(names.__getitem__, ids)) == whole for names, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def aligned(self, text: bytes | None) -> tuple:
        """(n_a, n_b, n_groups, n_links, digest of the groups, exact ids and times, irregular keys and times).

        Ids, keys and times are stored as bytes: exact links as ids of the first, the others as pair
        keys; each distinct one once, ascending, with how often it occurs.
        """
        a, b = self.encoded(text)
        if not len(a):
            return 0, 0, 0, 0, "", b"", b"", b"", b""
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cut, b_cut = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        # a token of the first overlaps those of the second from the one that holds its first byte to
        # the one that holds its last
        first = np.searchsorted(b_ends, a_ends - self.lengths[0][a], "right")
        many = np.searchsorted(b_ends, a_ends - 1, "right") - first + 1
        left = np.repeat(a, many)
        right = b[np.arange(len(left)) - np.repeat(np.cumsum(many) - many - first, many)]
        same = self.identity[left] == right
        exact, n_exact = np.unique(left[same], return_counts=True)
        pairs, n_pairs = np.unique(left[~same] * SHIFT + right[~same], return_counts=True)
        return (len(a), len(b), len(cuts), len(left), self.digest(a, b, a_cut, b_cut), exact.astype("<i4").tobytes(),
                n_exact.astype("<i4").tobytes(), pairs.astype("<i8").tobytes(), n_pairs.astype("<i4").tobytes())


def stored_links(docs: DataFrame, tools: Tokenizers) -> DataFrame:
    """Every row's counts, digest and links, written once; ``_row`` numbers the rows."""
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_exact", "_n_exact", "_pairs", "_n_pairs"]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tools.aligned(text.as_py()) for text in batch.column(1).cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, " \
             "_exact binary, _n_exact binary, _pairs binary, _n_pairs binary"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
    return materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "links")


def _split(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a batch's byte strings, and the row of each."""
    parts = [np.frombuffer(v.as_py(), kind) for v in column]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, kind)).astype(np.int64), np.repeat(np.arange(len(parts)), sizes)


def document_counts(links: DataFrame, tools: Tokenizers, buffered: int = BUFFERED) -> DataFrame:
    """(key, exact, n): how many documents hold each linked pair of ids.

    A task counts exact links in a vector as long as the first vocabulary and irregular ones in a
    buffer of bounded size; only its counts are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, n: np.ndarray, exact: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()),
                                               pa.array(np.full(len(keys), exact))], ["key", "n", "exact"])

        vector, held, size = np.zeros(len(tools.identity), np.int64), [], 0
        for batch in batches:
            vector += np.bincount(_split(batch.column(0), "<i4")[0], minlength=len(vector))
            keys, _ = _split(batch.column(1), "<i8")
            held.append(np.unique(keys, return_counts=True))
            size += len(held[-1][0])
            if size > buffered:
                yield out(*_merged(held), False)
                held, size = [], 0
        if held:
            yield out(*_merged(held), False)
        ids = np.flatnonzero(vector)
        yield out(ids * SHIFT + tools.identity[ids], vector[ids], True)

    counts = links.select("_exact", "_pairs").mapInArrow(run, "key bigint, n bigint, exact boolean")
    return materialize(counts.groupBy("key", "exact").agg(F.sum("n").alias("n")), "pair_counts")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of the irregular pairs in at least the returned number of documents: ``most`` at most.

    The limit is the lowest power of two that leaves no more pairs than that; 0 if all are taken.
    """
    pairs = counts.where("not exact")
    sizes = {r["b"]: r["c"] for r in pairs.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    bits, total = 64, 0                           # at most 64 sizes
    while bits > 0 and total + sizes.get(bits, 0) <= most:
        total, bits = total + sizes.get(bits, 0), bits - 1
    limit = 0 if bits == 0 else 1 << bits
    found = pairs.where(F.col("n") >= limit).select("key", "n").toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], limit


def compared(docs: DataFrame, first: str | None = None, second: str | None = None, frequent: int = FREQUENT,
             buffered: int = BUFFERED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A null or empty text, or one that either tokenizer changes, has zeros and no digest. Repeated rows are
    documents of their own. The counts of exact links and each id's highest count are vectors as long as
    the vocabulary; those of at most ``frequent`` irregular pairs go with the tasks. Rarer pairs are
    looked up by a join on the pair, none of which has more rows than the limit of the frequent ones.
    """
    tools = Tokenizers(first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND))
    links = stored_links(docs, tools)
    counts = document_counts(links, tools, buffered)
    size = len(tools.identity)
    exact_n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    a = F.shiftright("key", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("best"))
    for row in counts.where("exact").select(a.alias("a"), "n").collect():        # a vocabulary at most
        exact_n[row["a"]] = row["n"]
    for row in highest.collect():                                               # a vocabulary at most
        best[row["a"]] = row["best"]
    keys, key_n, limit = _frequent(counts, frequent)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def placed(keys_here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, keys_here), max(len(keys) - 1, 0))
        return at, keys[at] == keys_here if len(keys) else np.zeros(len(keys_here), bool)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = _split(batch.column("_exact"), "<i4")
            times, n = _split(batch.column("_n_exact"), "<i4")[0], batch.num_rows
            pairs, pair_row = _split(batch.column("_pairs"), "<i8")
            at, known = placed(pairs)
            pair_n = key_n[at[known]]
            rows = np.concatenate([row, pair_row[known]])
            times = np.concatenate([times, _split(batch.column("_n_pairs"), "<i4")[0][known]])
            found = np.concatenate([exact_n[ids], pair_n])
            top = found == best[np.concatenate([ids, pairs[known] >> 32])]
            sums, tops = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, rows, times * found)
            np.add.at(tops, rows, times * top)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*columns, "_row"]), pa.array(tops), pa.array(sums)],
                                             [*columns, "_row", "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, row = _split(batch.column("_pairs"), "<i8")
            times, left = _split(batch.column("_n_pairs"), "<i4")[0], ~placed(pairs)[1]
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(row[left])), pa.array(pairs[left]),
                                              pa.array(times[left])], ["_row", "key", "times"])

    out = links.select(*columns, "_row", "_exact", "_n_exact", "_pairs", "_n_pairs").mapInArrow(
        totals, ", ".join(f"{c} {dict(links.dtypes)[c]}" for c in [*columns, "_row"]) + ", n_best bigint, count_sum bigint")
    if limit:
        rows = links.select("_row", "_pairs", "_n_pairs").mapInArrow(rare, "_row bigint, key bigint, times bigint")
        known = (counts.where(~F.col("exact") & (F.col("n") < limit)).withColumn("a", a)
                 .join(F.broadcast(highest), "a")                                # a vocabulary at most
                 .select("key", "n", (F.col("n") == F.col("best")).cast("bigint").alias("top")))
        more = rows.join(known, "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"),
                                                           F.sum(F.col("times") * F.col("top")).alias("_top"))
        out = out.join(more, "_row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_top", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
