"""Operators with vectorised Python: packing, quality, language, SimHash, repeated passages, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trailmix.llm import langid, packing, quality, simhash, substrings

from .conftest import PROSE


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- packing

def best_possible(lengths, size):
    """Fewest sequences by trying everything; for a handful of pieces."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1:])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("size", [7, 12, 25])
def test_plan_is_whole_and_reduction_is_safe(size):
    rng = random.Random(size)
    for _ in range(150):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 9))]
        plan, counts = packing.packing_plan(Counter(lengths), size), Counter()
        for pattern, times in plan.patterns:
            assert 0 < sum(n * k for n, k in pattern) <= size
            for n, k in pattern:
                counts[n] += k * times
        assert counts == Counter(lengths)
        fixed, left = packing.Plan(size), np.zeros(size + 1, np.int64)
        for n in lengths:
            left[n] += 1
        packing.reduce_dominated(left, fixed)
        rest = [n for n in range(size + 1) for _ in range(left[n])]
        assert fixed.sequences() + best_possible(rest, size) == best_possible(lengths, size)     # nothing is lost
        assert plan.sequences() <= best_possible(lengths, size) * 11 / 9 + 1


def test_pieces_and_places(make_docs):
    rng = random.Random(5)
    vocab = PROSE.split() + ["It's", "CAN'T", "é", "ǰ", "½", "<|endoftext|>", "x_y!!", "漢字", " ", "don'tstop", "12ab"]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))) for k in range(60)] + [(7, "tie"), (7, "tie"), (99, None)]
    docs = make_docs(rows)
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for key, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 32):
            part = np.array(ids[at:at + 32], "<u4").tobytes()
            want[key, at // 32, at, len(part) // 4, zlib.crc32(part)] += 1
    got = packing.packed(docs, size=32).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 32
    assert packing.packed(make_docs([])).count() == 0
    kept = packing.pieces(docs, keep_ids=True).first()
    assert zlib.crc32(kept["ids"]) == kept["ids_crc32"]


def test_packing_odd_rows(odd_docs):
    rows = packing.packed(odd_docs).collect()
    by_id = Counter(r["doc_id"] for r in rows)
    assert by_id[1] == 2 and by_id[7] == -(-60_001 // 4096) and by_id[None] == 2
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}


# ---- quality

def brute_counts(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_statistics_match_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "é", "漢 ", "\n", "\n\n", " ", "\x0b", "\x1c", "#", "|", "the same line again\n", "a b a b a b a b a "])
                       for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text.encode())[0] == brute_counts(text), repr(text)


def quality_rows(n=150):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(25, 80)))) for i in range(n)]
    bad = [(1000 + i, " ".join(rng.choice(PROSE.split()) + rng.choice(["###", "%%%", "&&&"]) for _ in range(rng.randint(25, 80)))) for i in range(n)]
    return good, bad


def test_quality_trees_learn_and_are_monotone(spark, make_docs):
    good, bad = quality_rows()
    labels = spark.createDataFrame([(k, 1) for k, _ in good[:100]] + [(k, 0) for k, _ in bad[:100]] + [(None, 1), (5, 1)], "doc_id bigint, quality int")
    docs = make_docs(good + bad)
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert all(got[k]["kept"] or got[k]["base_failed"] for k, _ in good) and not any(got[k]["kept"] for k, _ in bad)
    assert set(r["doc_id"] for r in quality.kept(docs, labels).collect()) == {k for k, r in got.items() if r["kept"]}
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(600) + 0.5 * np.sin(9 * x[:, 0]) < 0.7).astype(float)
    trees = quality.fit_trees(x, y, list(quality.FEATURES.values()))
    p = trees.probability(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9
    for k, sign in enumerate(quality.FEATURES.values()):
        if sign:
            steps = [trees.probability(np.where(np.arange(x.shape[1]) == k, v, x)) for v in np.linspace(0, 1, 15)]
            assert all((sign * (b - a) >= -1e-12).all() for a, b in zip(steps, steps[1:], strict=False))


def test_quality_odd_rows(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.judged(odd_docs, labels).collect()
    assert len(rows) == 12 and all(r["base_failed"] for r in rows if r["doc_id"] in (3, 4, 5, 7, 8))
    assert quality.kept(odd_docs, labels).columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in quality.kept(odd_docs, labels).collect()) == {1: 2, 2: 1, None: 1}
    assert quality.judged(make_docs([]), labels).count() == 0


# ---- language

def test_language_is_learned_and_held_out(make_docs):
    rng = random.Random(2)
    parts = {"en": ["the", "and", "tion", "ing", "wh"], "de": ["sch", "ung", "und", "eit", "ü"], "fr": ["eau", "é", "que", "ou", "le"]}
    rows = []
    for k in range(360):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 200))), lang, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "123 !! 漢"[:6], None, None, None), (1002, "漢", None, None, None), (None, "the and", None, None, None)]
    got = {r["doc_id"]: r for r in langid.identified(make_docs(rows)).collect()}
    held = [r for r in rows[:360] if got[r[0]]["held_out"]]
    assert all((zlib.crc32(str(r[0]).encode()) % 3 == 1) == got[r[0]]["held_out"] for r in rows[:360])
    assert len(held) > 80 and sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" != got[1002]["lang_pred"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (6, langid.LENGTH)).astype(np.uint8), np.array([0, 1, 0, 1, 0, 1])
    x[1::2, ::2] = 120
    net = langid.train(x, y, ["a", "b"], epochs=60, batch=6)
    assert (net.probabilities(x).argmax(1) == y).all()
    part = x.astype(int)
    for row, p in zip(part, net.probabilities(x), strict=True):                      # tables against the plain network
        pooled = [max(sum(net.vectors[row[i + j]] @ bank[j] for j in range(len(bank)))[f] for i in range(langid.LENGTH - len(bank) + 1))
                  for bank in net.banks for f in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(langid.softmax(z[None])[0], p, atol=1e-4)


def test_language_odd_rows(odd_docs, make_docs):
    rows = langid.identified(odd_docs).collect()
    assert len(rows) == 12 and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert langid.identified(make_docs([])).count() == 0
    assert langid.identified(make_docs([(1, "abc", None, None, None)])).first()["lang_pred"] == "und"


# ---- SimHash

def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams)) if grams else 0


def test_fingerprint_matches_brute_force():
    for text in ["", " \n", "One", "One TWO", "Ünï ÀB c d", PROSE, PROSE.upper(), "a b c " * 50, "x\x0by\x1cz w"]:
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_join_what_brute_force_joins(spark, block):
    rng = random.Random(block)
    seeds, fps = [rng.getrandbits(64) for _ in range(40)], set()
    for s in seeds:
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                s ^= 1 << b
            fps.add(s)
    fps |= {1 << b for b in range(64)} | {0}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(pairs):
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(f) for f in fps]

    want = join((a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    root = {f: f for f in fps}
    assert join(map(tuple, simhash.links(table, block=block).collect())) == want


def test_simhash_groups_and_keeps_one(odd_docs, make_docs):
    rows = [(5, PROSE), (9, PROSE.upper()), (3, "something else entirely here"), (8, PROSE), (None, "lonely text without id"), (3, "something else entirely here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.grouped(make_docs(rows)).collect()}
    assert got == {(5, 5), (9, 5), (8, 5), (3, 3), (None, None)}
    kept = simhash.one_of_each(make_docs(rows, extra=True)).collect()
    assert Counter(r["doc_id"] for r in kept) == {5: 1, 3: 1, None: 1}
    out = simhash.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns and Counter(r["doc_id"] for r in out.collect())[1] == 1
    assert {r["component_id"] for r in simhash.grouped(odd_docs).collect() if r["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.grouped(make_docs([])).count() == 0 == simhash.one_of_each(make_docs([])).count()


# ---- repeated passages

def brute_cut(rows, width):
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            run, when = tuple(w[i:i + width]), (float("inf") if key is None else key, i)
            first[run] = min(first.get(run, when), when)
    out = []
    for key, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < (float("inf") if key is None else key, i) for j in range(i, i + width)}
        out.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 2_000, "shard_cells": 256, "shard_words": 64}])
def test_repeats_match_brute_force(make_docs, sizes):
    rng = random.Random(7)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(rng.randrange(10_000), "  \n".join(rng.choice(passages) + rng.choice([" x", " é", ""]) for _ in range(rng.randint(0, 6)))) for _ in range(120)]
    rows += [(rows[0][0], rows[0][1]), (None, passages[0] + " " + passages[1]), (-5, passages[1])]
    got = substrings.without_repeats(make_docs(rows), **sizes).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_cut(rows, 20), key=key)


def test_repeats_odd_rows(odd_docs, make_docs):
    rows = substrings.without_repeats(odd_docs).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["n_removed"] == 60_000 - 1 and by_id[3]["kept"] == "" and by_id[2]["n_removed"] == len(words(PROSE))
    assert [r["n_removed"] for r in rows if r["doc_id"] == 1] == [0, 0]
    assert substrings.without_repeats(make_docs([])).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, make_docs, tmp_path):
    good, bad = quality_rows(120)
    secret = "".join(random.Random(3).choice("0123456789abcdef") for _ in range(40))
    good = [(k, f'{t} token = "{secret}" x{k}' if k < 30 else t) for k, t in good]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in good + bad] + [(5000 + k, t, "en", "s1", len(t)) for k, t in good[40:60]]
    rows += [(9000, None, None, None, None), (9001, "", "en", None, 0)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    kept = {r["doc_id"] for r in seen["quality_rules"]}
    assert {k for k, t in good if len(words(t)) >= 20} <= kept and not kept & {k for k, _ in bad}
    alone = [r["doc_id"] for r in seen["simhash_near_dedup"]]
    assert len(alone) == len(set(alone)) and not set(alone) & set(range(5040, 5060)) and set(alone) <= kept
    assert [r["doc_id"] for r in sorted(seen["secret_scans"])] == sorted(alone) and not any(secret in r["text"] for r in seen["secret_scans"])
    mixed = Counter(r["doc_id"] for r in seen["mixing_sources"])
    assert set(mixed) <= set(alone) and max(mixed.values()) <= 3
    pieces = Counter(r["doc_id"] for r in seen["best_fit_packing"] if r["piece"] == 0)
    assert pieces == mixed
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    part = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert part(again) == part(seen["best_fit_packing"])
