"""Near-duplicates by SimHash: generalised pigeonhole search among distinct fingerprints.

A fingerprint's bits are dealt into parts, correlated bits together. If the parts of two fingerprints
differ in at least u_1, u_2, ... bits and the u_i add up to more than the allowed distance, the two are
too far apart; so it is enough to probe each part i for values at most u_i - 1 bits away, with
u_1 + u_2 + ... = distance + 1. Every fingerprint gets its own u_i, those with the fewest estimated
candidates, by dynamic programming; a part with a very common value then gets u_i = 0 and is not probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
BLOCK = 2048                # rows of one part's value that meet in one group; larger groups meet block by block
SAMPLE = 20_000             # fingerprints from which the correlation of bits is estimated
CELLS = 16                  # bits of a part's value that candidate counts are kept for
PROBE = 8.0                 # cost of one probed value, in candidates
_bits = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text (UTF-8) as a signed number; zero without words."""
    words = text.lower().split()            # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        found = [hashed(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]])
        found = [hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)]
    values = np.array(found, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((values + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _bits
    return int.from_bytes(np.packbits((2 * counts > len(found)).ravel(), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, columns: list, shingle: int = SHINGLE) -> DataFrame:
    """The given columns and ``fp`` of every row."""
    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    names = [c for c in rows.columns if c != "_text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("_text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "_text")
    return rows.mapInArrow(work, f"{kinds}, fp bigint")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    bits = ((sample.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0) if len(bits) else 0
    scale = np.sqrt((bits ** 2).sum(0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(scale, scale), 1e-9)
    free, groups = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(free, key=lambda b: (near[b][free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (near[b][group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    fp, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for place, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out.astype(np.int64)


def balls(counts: np.ndarray, radius: int) -> np.ndarray:
    """Row r: the number of counted values at most r bits from each value."""
    spheres = [counts.astype(float)] + [np.zeros(len(counts)) for _ in range(radius)]
    index = np.arange(len(counts))
    for bit in range((len(counts) - 1).bit_length()):
        spheres = [s + (spheres[r - 1][index ^ (1 << bit)] if r else 0) for r, s in enumerate(spheres)]
    return np.cumsum(spheres, 0)


def allocation(costs: list[np.ndarray]) -> np.ndarray:
    """Units of each part (rows) for each fingerprint, the cheapest that add up to the last cost column's index."""
    units = costs[0].shape[1] - 1
    best, choices = np.where(np.arange(units + 1) == 0, 0.0, np.inf) + np.zeros((len(costs[0]), 1)), []
    for cost in costs:
        tried = np.stack([np.concatenate([np.full((len(best), u), np.inf), best[:, :units + 1 - u] + cost[:, u:u + 1]], 1)
                          for u in range(units + 1)])
        choices.append(tried.argmin(0))
        best = tried.min(0)
    left, out = np.full(len(best), units), []
    for choice in reversed(choices):
        out.append(choice[np.arange(len(best)), left])
        left = left - out[-1]
    return np.array(out[::-1])


def forest(fp: np.ndarray, role: np.ndarray, end: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of a sorted table as (row, first row it reaches), one for each row that has one.

    Rows i and i + d of one group are compared for growing d, all groups at once. Pairs are not kept:
    they only join labels, so the answer has fewer rows than the table.
    """
    label, pending, n = np.arange(len(fp)), [], 0

    def join():
        nonlocal pending, n
        if pending:
            a, b = (np.concatenate(x) for x in zip(*pending, strict=True))
            while len(a):
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label[:] = label[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        pending, n = [], 0

    at, d = np.flatnonzero(end > np.arange(len(fp)) + 1), 1
    while len(at):
        other = at + d
        hit = (np.bitwise_count((fp[at] ^ fp[other]).view(np.uint64)) <= distance) & ((role[at] | role[other]) == 3)
        hit &= label[at] != label[other]
        if hit.any():
            pending.append((at[hit], other[hit]))
            n += int(hit.sum())
            if n > 100_000:
                join()
        d += 1
        at = at[end[at] > at + d]
    join()
    rows = np.flatnonzero(label != np.arange(len(fp)))
    return rows, label[rows]


def links(distinct: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(src, dst) links among the distinct fingerprints of a stored table (fp).

    The links hold every pair at most ``distance`` bits apart together, directly or through others
    that are linked too: within a probed group only a spanning forest is returned, never all pairs.
    The parts are cut so that a value is rare on average (about 20, 27 and more bits of fingerprints need
    wider parts); that changes what is compared, never what is found.
    """
    n = distinct.count()
    parts = 4 if n <= 1 << 20 else 3 if n <= 1 << 27 else 2
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    groups = bit_groups(np.array(sorted(r[0] for r in distinct.where(part).select("fp").collect()), np.int64), parts)
    units, cells = distance + 1, 1 << CELLS

    def values(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            found = np.concatenate([k * cells + (part_values(fp, g) & (cells - 1)) for k, g in enumerate(groups)])
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["cell"])

    # counts over all fingerprints: parts x 65,536 numbers at most
    counted = distinct.select("fp").mapInArrow(values, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(parts * cells)
    counts[[r[0] for r in counted]] = [r[1] for r in counted]
    tables = []
    for k, group in enumerate(groups):
        near = balls(counts[k * cells:(k + 1) * cells], units - 1) * 2.0 ** (CELLS - len(group))
        probes = np.cumsum([comb(len(group), r) for r in range(units)])
        tables.append(np.concatenate([np.zeros((1, cells)), near + PROBE * probes[:, None]]).T.astype(np.float32))

    def probes(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            own = [part_values(fp, g) for g in groups]
            given = allocation([t[v & (cells - 1)] for t, v in zip(tables, own, strict=True)])
            for k, (group, value, u) in enumerate(zip(groups, own, given, strict=True)):
                out = [(value, fp, np.where(u > 0, 3, 1))]           # 1: can be found, 2: looks, 3: both
                for r in range(1, int(u.max(initial=0))):
                    far = u > r
                    for flips in combinations(range(len(group)), r):
                        out.append((value[far] ^ sum(1 << f for f in flips), fp[far], np.full(far.sum(), 2)))
                value, who, role = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), k, np.int32)), pa.array(value), pa.array(who),
                                                  pa.array(role.astype(np.int32))], ["part", "value", "fp", "role"])

    rows = materialize(distinct.select("fp").mapInArrow(probes, "part int, value bigint, fp bigint, role int"), "probes")
    blocks = F.ceil(F.col("n") / block)
    large = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > block).select(
        "part", "value", blocks.alias("_blocks"))
    dealt = rows.join(large, ["part", "value"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("_blocks"))
    dealt = (dealt.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
             .select("part", "value", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"), "fp", "role"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        def found(table):
            keys = np.stack([table[:, 0], table[:, 1], table[:, 2], table[:, 3]], 1)
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            end = np.repeat(np.append(first[1:], len(table)), np.diff(np.append(first, len(table))))
            fp = np.ascontiguousarray(table[:, 4])
            a, b = forest(fp, table[:, 5], end, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["src", "dst"])
        for batch in batches:
            table = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            rest = table if rest is None else np.concatenate([rest, table])
            new = np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(1))
            if len(new):                                     # the last group may go on in the next batch
                yield found(rest[:new[-1] + 1])
                rest = rest[new[-1] + 1:]
        if rest is not None and len(rest):
            yield found(rest)

    on = ["part", "value", "a", "b"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = dealt.repartition(tasks, *on).sortWithinPartitions(*on)
    return near.mapInArrow(compare, "src bigint, dst bigint")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of a stored table (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = components(links(distinct, distance))
    known = distinct.join(parts, distinct["fp"] == parts["vertex"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, "roots")
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(lowest, "root").select("fp", "root", "component_id")


def grouped(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Texts that are null, empty or without words have the fingerprint zero and are linked like any
    other. Rows without a doc_id are linked too; a group of such rows alone has no component_id.
    """
    prints = materialize(fingerprints(docs, ["doc_id"], shingle), "prints")
    # a fingerprint may hold a third of all rows: the join's large side is split at run time
    rows = prints.join(classes(prints, distance), "fp")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with the columns of ``docs``.

    Among rows of that doc_id the one with the smallest hash of all its columns stays; of equal rows
    one stays. A group of rows without a doc_id keeps one row in the same way.
    """
    names = [f"`{c}`" for c in docs.columns]
    digest = F.xxhash64(*names)
    prints = materialize(fingerprints(docs, [F.col("doc_id"), digest.alias("_digest")], shingle), "prints")
    rows = prints.join(classes(prints, distance), "fp")
    least = (rows.groupBy("root", "doc_id", "_digest").agg(F.count("*").alias("_n"))
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_digest", "_n")).alias("_s")))
    least = least.select(F.col("_s.doc_id").alias("_id"), F.col("_s._digest").alias("_keep"), F.col("_s._n").alias("_n"))
    least = materialize(least, "kept")
    whole = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_doc"), digest.alias("_digest"))
    kept = whole.join(least, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_keep")))
    return kept.where("_n = 1").select("_row").union(kept.where("_n > 1").select("_row").distinct()).select("_row.*")
