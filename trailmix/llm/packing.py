"""Packing token sequences: dominance reduction fixes sets of pieces, best fit places the rest.

Both work on the number of pieces of each length. That table has at most ``size`` rows however many
documents there are, so planning is a small step on the driver; the pieces themselves are counted,
ranked and placed by Spark.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .alphabet import byte_alphabet

SIZE = 4096
VOCABULARY = "word_bpe_49k.json"
END = 1                     # the id after each document
# How the vocabulary marks the end of a word, and the byte that stands for it here.
WORD_END, STOP = "</w>", b"\0"

PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


class Encoder:
    """Ids (little-endian, 32 bits) of a text.

    The vocabulary's rules never look across white space. Words of Latin letters and ASCII signs, whole
    runs of them at once, go through a merge engine that needs only the order of the merges: each part
    ends in a byte that stands for the end of a word, and merging it to the part's last letter comes
    before all else. All other words go through the whole tokenizer, also in runs. Nothing is
    remembered from one text to the next.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters = byte_alphabet()
        ranks = {}
        for token, k in self.whole.get_vocab(with_added_tokens=False).items():
            name = bytes(letters[c] for c in token.removesuffix(WORD_END))
            if STOP not in name:
                ranks[name + STOP * token.endswith(WORD_END)] = k
        self.merges = tiktoken.Encoding("parts", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        # The vocabulary's own splitting pattern, its letters and numbers those of the plain signs.
        letter, number = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.odd = re.compile("[^\t-\r -~¡-įı-ſ]|<\\|").search

    def plain(self, text: str) -> np.ndarray:
        parts = self.split(text.lower())
        parts.append("")
        return np.array(self.merges.encode_ordinary("\0".join(parts)), "<u4")

    def ids(self, text: bytes) -> bytes:
        whole = text.decode()
        if not self.odd(whole):
            return self.plain(whole).tobytes()
        runs = ((odd, " ".join(words)) for odd, words in groupby((w.decode() for w in text.split()), lambda w: bool(self.odd(w))))
        return b"".join((np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4") if odd else self.plain(run)).tobytes()
                        for odd, run in runs)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every row's token ids, cut at ``size``.

    ``ids`` holds the ids themselves if asked for, else null. A null text is an empty one: the
    piece then holds the end id alone. Repeated rows give repeated pieces.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, texts = [[] for _ in range(6)], batch.column(1).cast(pa.binary())
            for n, text in enumerate(texts):
                ids = tool.ids(text.as_py() or b"") + last
                for k in range(0, len(ids), 4 * size):
                    part = ids[k:k + 4 * size]
                    for column, value in zip(rows, (n, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part),
                                                    part if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rows[1:], kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, PIECES.format(kind=kind))


class Plan:
    """Patterns of lengths with the number of sequences filled that way."""

    def __init__(self, size: int):
        self.size, self.patterns = size, []

    def add(self, pattern: list[tuple[int, int]], times: int) -> None:
        if times:
            self.patterns.append((pattern, times))

    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, per sequence, first sequence, offset): where the pieces of a length go.

        The pieces of a length are numbered; those from ``first rank`` on fill one pattern's sequences,
        ``per sequence`` each. There are as many rows as pattern entries, whatever the table's size.
        """
        rank, rows, base = Counter(), [], 0
        for pattern, times in self.patterns:
            offset = 0
            for length, k in pattern:
                rows.append((length, rank[length], k, base, offset))
                rank[length] += k * times
                offset += k * length
            base += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def reduce_dominated(left: np.ndarray, plan: Plan) -> None:
    """Fix the sets that some best packing contains, and take their pieces out of ``left``.

    For a piece of length a, in each case no set with it can do better:
    * nothing else fits beside it: it is alone;
    * a piece b fills the sequence to the last token: {a, b};
    * no two of the rest fit beside it: {a, b} with the longest b that fits.
    Equal pieces are fixed all at once. Passes repeat until nothing changes.
    """
    size, changed = plan.size, True
    while changed:
        changed = False
        for a in range(size, 0, -1):
            while left[a]:
                left[a] -= 1                      # the rest, seen from one piece of length a
                small = np.flatnonzero(left[:size - a + 1])
                twice = len(small) and (small[0] + (small[0] if left[small[0]] > 1 else small[1] if len(small) > 1 else size))
                left[a] += 1
                if not len(small):
                    pattern, times = [(a, 1)], (int(left[a]) if 2 * a > size else 1)
                else:
                    b = int(small[-1])
                    if a + b != size and a + twice <= size:
                        break
                    pattern = [(a, 2)] if a == b else [(max(a, b), 1), (min(a, b), 1)]
                    times = int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
                for length, k in pattern:
                    left[length] -= k * times
                plan.add(pattern, times)
                changed = True


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Longest first, each piece to the fullest sequence it fits in; equal pieces and sequences in bulk."""
    size = plan.size
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []                          # the free spaces that occur, sorted

    def put(pattern, times, room):
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, times))

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put([], n, size)
                continue
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            k = min(room // length, n)
            used = min(times, n // k)
            put([*pattern, (length, k)], used, room - k * length)
            if times > used and (pattern or n - used * k):
                put(pattern, times - used, room)
            n -= used * k
    for groups in open_.values():
        for pattern, times in groups:
            if pattern:
                plan.add(pattern, times)


def packing_plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = Plan(size)
    reduce_dominated(left, plan)
    best_fit(left, plan)
    return plan


def placed(cut: DataFrame, size: int = SIZE, rows_per_rank: int = 1_000_000) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``cut`` must be a stored table.

    A length may belong to a third of all pieces, so ranks within a length come from ranks within
    salted parts of it and a running total over the parts. An empty table gives an empty result.
    """
    cut = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, size)                         # at most ``size`` rows
    salts = 16 + sum(counts.values()) // rows_per_rank
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    within = F.row_number().over(W.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_within", within).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_within")).select(*cut.columns, "_rank")
    slots = plan.slots()
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            slot = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(length) else slots[:0]
            nth = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + nth // slot[:, 2], slot[:, 4] + nth % slot[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                [*keep, "sequence_id", "offset"])

    keep = [c for c in cut.columns if c != "_row"]
    out = ranked.select(*keep, "_rank")
    kinds = ", ".join(f"`{c}` {k}" for c, k in out.dtypes if c != "_rank")
    return out.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return placed(pieces(docs, path, size, end).drop("ids"), size)
