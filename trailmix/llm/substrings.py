"""Removing repeated passages: a count-min sketch finds the windows worth an exact look.

Documents are dealt into groups of bounded size by their id. A group counts each of its windows once
in a sparse sketch (its own repeats are settled inside the group); the groups' sketches are merged
cell range by cell range, and every group learns which of its cells another group has too. Cells are
shared by chance, so counts are over-estimated and no repeated window is lost. Only windows whose
cells are all shared go on to the exact pass, which finds the first document of each by hash range.
All five steps are one Spark query: the texts are shuffled once, and a lost executor costs the
recomputation of what it held.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import covered, window_hashes

WIDTH = 20                  # words of a window
GROUP_BYTES = 12_000_000    # text of a group of documents
DEPTH = 2                   # rows of the sketch
CELLS_A_WORD = 4            # cells of a sketch row for each word of the corpus
SHARD_CELLS = 1 << 23       # cells that are merged in one place
SHARD_WORDS = 1 << 20       # words of the corpus for each hash range of the exact pass
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
NO_ID = (1 << 63) - 1       # rows without a doc_id come last


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of equal weight, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(blob, kind), dtype=kind)


class _Codes(dict):
    """Numbers of words, with two 64-bit hashes of each."""

    def __init__(self):
        self.hashes = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_128_digest(word))
        return n


class Windows:
    """The distinct windows of a group of documents, sorted by hash, and where each first begins."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table.column("doc_id").to_numpy().astype(np.int64)
        self.texts = table.column("text").combine_chunks().cast(pa.binary())
        codes, parts = _Codes(), []
        for text in self.texts:
            words = (text.as_py() or b"").split()
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        every = np.concatenate(parts) if parts else np.empty(0, np.int32)
        hashes = np.frombuffer(b"".join(codes.hashes), "<u8").reshape(-1, 2)
        self.width, ends = width, np.cumsum(self.sizes)
        row = np.repeat(np.arange(len(parts)), self.sizes)
        place = np.arange(len(every)) - (ends - self.sizes)[row]
        starts = np.flatnonzero(place + width <= self.sizes[row])
        self.row, self.place = row[starts], place[starts]
        a, b = (window_hashes(hashes[every, k], width)[starts] if len(starts) else np.empty(0, np.uint64) for k in (0, 1))
        _, rank = np.unique(self.ids, return_inverse=True)
        when = (rank[self.row].astype(np.int64) << 40) | self.place
        order = np.argsort(a, kind="stable")
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[:len(order)]
        first = np.flatnonzero(new)
        self.a, self.b = a[order][first], (b[order][first] >> np.uint64(32)).astype(np.uint32)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        earliest = np.minimum.reduceat(when[order], first) if len(first) else when
        self.later = when > earliest[self.which] if len(first) else np.empty(0, bool)
        distinct = np.unique(self.ids)
        self.doc = distinct[earliest >> 40] if len(first) else np.empty(0, np.int64)

    def cells(self, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells of one sketch row, and each window's place among them."""
        cell = (self.a * np.uint64(ODD[depth])) >> np.uint64(64 - bits)
        return np.unique(cell, return_inverse=True)


def _shards(values: np.ndarray, shift: int):
    """(shard, slice) of sorted values that share all but their low ``shift`` bits."""
    if not len(values):
        return []
    high = values >> np.uint64(shift)
    first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
    return [(int(high[i]), slice(i, j)) for i, j in zip(first, [*first[1:], len(high)], strict=True)]


KEYED = "kind int, shard bigint, g int, blob binary, more binary, ids binary"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (("kind", pa.int32()), ("shard", pa.int64()), ("g", pa.int32()), ("blob", pa.binary()), ("more", pa.binary()), ("ids", pa.binary()))
    return pa.Table.from_pydict({n: [r[k] for r in rows] for k, (n, _) in enumerate(kinds)}, pa.schema(kinds))


def without_repeats(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES, depth: int = DEPTH,
                    shard_cells: int = SHARD_CELLS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row.

    A word goes if it lies in a window of ``width`` words that also starts earlier: in a row with a
    smaller doc_id, or with the same doc_id at an earlier word. ``kept`` is the rest, joined by single
    spaces. All windows are judged on the texts as given. A null text has no words; rows without a
    doc_id come after all others; repeated rows of one doc_id do not count as earlier than each other.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, words = max(parts, math.ceil(size / group_bytes)), max(1, size // 6)
    bits = max(int(math.log2(shard_cells)), math.ceil(math.log2(words * CELLS_A_WORD)))
    cell_shift = int(math.log2(shard_cells))
    hash_shift = 64 - max(1, math.ceil(math.log2(max(2, words / shard_words))))

    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    dealt = docs.select(F.pmod(F.xxhash64(number), F.lit(groups)).cast("int").alias("g"), number.alias("doc_id"),
                        F.col("text").cast("string").alias("text")).repartition(groups, "g")

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, g = Windows(table, width), key[0].as_py()
        out = []
        for d in range(depth):
            for shard, part in _shards(cells := found.cells(d, bits)[0], cell_shift):
                inside = (cells[part] & np.uint64(shard_cells - 1)).astype(np.uint32)
                out.append((d, shard, g, pack_sorted(inside), None, None))
        return _rows(out)

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(shard_cells, np.uint8)
        blobs = [unpack_sorted(b.as_py(), np.uint32) for b in table.column("blob")]
        for cells in blobs:
            counts[cells] = np.minimum(counts[cells] + 1, 2)
        kinds, shards, gs = (table.column(c).to_pylist() for c in ("kind", "shard", "g"))
        return _rows([(k, s, g, np.packbits(counts[c] > 1).tobytes(), None, None)
                      for k, s, g, c in zip(kinds, shards, gs, blobs, strict=True)])

    def answers(table: pa.Table, kind: int, sizes: list[int]) -> np.ndarray:
        """One group's answers of a kind, shard after shard, as flags."""
        rows = sorted((s, b) for k, s, b in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "blob")), strict=True) if k == kind)
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for (_, b), n in zip(rows, sizes, strict=True)]
        return np.concatenate(flags).astype(bool) if flags else np.empty(0, bool)

    def suspects(key: tuple[pa.Scalar, ...], texts: pa.Table, table: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        found, g = Windows(texts, width), key[0].as_py()
        shared = np.ones(len(found.a), bool)
        for d in range(depth):
            cells, which = found.cells(d, bits)
            shared &= answers(table, d, [p.stop - p.start for _, p in _shards(cells, cell_shift)])[which]
        a, b, doc = found.a[shared], found.b[shared], found.doc[shared]
        out = [(1, -1 - g, g, np.packbits(shared).tobytes(), None, None)]
        for shard, part in _shards(a, hash_shift):
            low = int(doc[part].min())
            out.append((0, shard, g, pack_sorted(a[part]), pack(b[part]),
                        low.to_bytes(8, "little", signed=True) + pack((doc[part] - low).view(np.uint64))))
        return _rows(out)

    def exact(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:             # a group's note to itself
            return table
        gs, a, b, doc = [], [], [], []
        for g, x, y, z in zip(*(table.column(c).to_pylist() for c in ("g", "blob", "more", "ids")), strict=True):
            gs.append(g)
            a.append(unpack_sorted(x, np.uint64))
            b.append(unpack(y, np.uint32))
            doc.append(unpack(z[8:], np.uint64).view(np.int64) + int.from_bytes(z[:8], "little", signed=True))
        sizes = [len(x) for x in a]
        a, b, doc = (np.concatenate(x) for x in (a, b, doc))
        order = np.lexsort((doc, b, a))
        same = np.concatenate([[False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])])
        later = np.empty(len(a), bool)
        later[order] = same                                  # the smallest doc_id of a window comes first
        ends = np.cumsum(sizes)
        shard = table.column("shard")[0].as_py()
        return _rows([(0, shard, g, np.packbits(later[e - n:e]).tobytes(), None, None) for g, e, n in zip(gs, ends, sizes, strict=True)])

    def cut(texts: pa.Table, table: pa.Table) -> pa.Table:
        found, at = Windows(texts, width), 0
        shared = answers(table, 1, [len(found.a)])
        earlier = np.zeros(len(found.a), bool)
        earlier[shared] = answers(table, 0, [p.stop - p.start for _, p in _shards(found.a[shared], hash_shift)])
        gone = found.later | earlier[found.which]
        first = np.searchsorted(found.row, np.arange(len(found.sizes) + 1))
        n_removed, kept = [], []
        for k, text in enumerate(found.texts):
            words = (text.as_py() or b"").split()
            starts = found.place[first[k]:first[k + 1]][gone[first[k]:first[k + 1]]]
            out = covered(starts, width, len(words)) if len(starts) else None
            n_removed.append(int(out.sum()) if out is not None else 0)
            kept.append(b" ".join(words if out is None else [words[i] for i in np.flatnonzero(~out)]).decode())
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(found.sizes), "n_removed": pa.array(n_removed, pa.int64()),
                         "kept": pa.array(kept, pa.string())})

    sketches = dealt.groupBy("g").applyInArrow(sketch, KEYED)
    merged = sketches.groupBy("kind", "shard").applyInArrow(merge, KEYED)
    asked = dealt.groupBy("g").cogroup(merged.groupBy("g")).applyInArrow(suspects, KEYED)
    found = asked.groupBy("kind", "shard").applyInArrow(exact, KEYED)
    out = dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
lost AS (SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w
    ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
