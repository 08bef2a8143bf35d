"""Toxicity, tokenizer alignment and the audit of filters: brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trailmix.llm import alignment, audit, toxicity

from .conftest import PROSE

LABELS = "doc_id bigint, quality int, toxic int"


def labelled(spark, rows):
    return spark.createDataFrame(rows, LABELS)


# ---- toxicity

@pytest.mark.parametrize("text, words", [
    ("You 1d10t! $tupid m0r0n", "you idiot stupid moron"), ("l0ser!! st​up1d", "loser stupid"),
    ("ѕсum ｓｔｕｐｉｄ pathétic", "scum stupid pathetic"), ("a$$$ costs 4.0 or 10", "a costs or"), ("", ""), ("?!  12", "")])
def test_folding_undoes_disguises(text, words):
    assert toxicity.folded(text).split() == words.split()
    assert toxicity.folded(text).count(" ") == len(words.split()) + 1


def hits(words, text):
    """Weight of the longest listed term at each word that no exception covers, word by word."""
    spaced, total, free = toxicity.folded(text), 0.0, set()
    for phrase in words.exceptions:
        for at in range(len(spaced)):
            if spaced.startswith(phrase, at):
                free |= set(range(at, at + len(phrase) - 1))      # its last space begins the next word
    for at, c in enumerate(spaced):
        found = [t for t in words.weights if spaced.startswith(t, at)] if c == " " and at not in free else []
        total += words.weights[max(found, key=len)] if found else 0
    return total


def test_hits_match_brute_force():
    rng, words = random.Random(5), toxicity.lexicon({" achl": 2.0, " achlichk": 3.5, " scumb": 1.0})
    pool = ["idiot", "trash", "can", "achlich", "achlichkeit", "scumble", "not", "stupid", "clown", "fish", "tree", "idiots"]
    for _ in range(200):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 12)))
        x = words.features(text)
        assert x[1] == pytest.approx(math.log1p(hits(words, text)))
    assert words.features("a trash can for the clown fish")[5] == 0 and words.features("trash, can!")[5] == 0
    assert words.features("trash")[5] == 1


def toxic_rows(n=900):
    """A listed insult, or words with a beginning that only the labels can teach."""
    rng, rows, marks = random.Random(6), [], []
    for i in range(n):
        words, bad = rng.choices(PROSE.split(), k=rng.randint(20, 60)), i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["m0ron", "stupid"]) if i % 2 else "grumpf" + rng.choice(PROSE.split()))
        rows.append((i, " ".join(words) + f" {i}"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_learns_and_holds_out(spark, make_docs):
    rows, marks = toxic_rows()
    docs, labels = make_docs(rows), labelled(spark, marks)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    truth = {i: t for i, _, t in marks}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    # labels of held-out rows change nothing, and neither does the partitioning
    turned = labelled(spark, [(i, 1, 1 - t if got[i]["held_out"] else t) for i, _, t in marks])
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.repartition(9), turned).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in got.items())


def test_toxicity_odd_rows(spark, odd_docs, make_docs):
    labels = labelled(spark, [(1, 1, 0), (2, 0, None), (None, 1, 1), (99, 1, 1)])
    got = toxicity.scored(odd_docs, labels).collect()
    assert len(got) == 12 and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert toxicity.scored(make_docs([(1, "you stupid idiot, moron, trash")]), labelled(spark, [])).first()["predicted"] == 1
    assert toxicity.scored(make_docs([]), labels).collect() == []


# ---- alignment

def brute_aligned(rows):
    """The other library's encoder of the first vocabulary, and quadratic loops."""
    first = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    letters, found, holds = alignment.byte_alphabet(), [], Counter()

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for part in parts:
            out.append((at, at + len(part)))
            at += len(part)
        return out

    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_parts = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b_parts = [piece(i) for i in b]
        if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            found.append((doc, 0, 0, [], Counter()))
            continue
        sa, sb = spans(a_parts), spans(b_parts)
        links = Counter((x, y) for x, (s, e) in zip(a, sa) for y, (t, f) in zip(b, sb) if s < f and t < e)
        cuts = [0, *sorted({e for _, e in sa} & {e for _, e in sb})]
        groups = [",".join(str(x) for x, (s, _) in zip(a, sa) if lo <= s < hi) + "|"
                  + ",".join(str(y) for y, (s, _) in zip(b, sb) if lo <= s < hi) for lo, hi in zip(cuts, cuts[1:])]
        found.append((doc, len(a), len(b), groups, links))
        holds.update(links.keys())
    top = Counter()
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return sorted((doc, na, nb, len(g), sum(l.values()), sum(k for p, k in l.items() if holds[p] == top[p[0]]),
                   sum(k * holds[p] for p, k in l.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
                  for doc, na, nb, g, l in found)


def alignment_rows():
    rng, syllables = random.Random(7), ["tho", "ing", "éa", "ß", "ble", "ion", "QU", "7", "日", "!", "x"]
    rows = [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    return rows + rows[:2] + [(100, None), (101, ""), (102, "<|endoftext|> <s> </s> <unk>"), (103, "a  b\n\n\tc "), (104, " lead"),
                              (105, "▁x"), (106, "<0x41> AAAA"), (107, "🙂🙂 naïve\u0000"), (108, "a" * 2000)]


@pytest.mark.parametrize("settings", [{}, {"frequent": 20, "buffered": 30}, {"frequent": 0}])
def test_alignment_matches_brute_force(make_docs, settings):
    rows = alignment_rows()
    got = alignment.compared(make_docs(rows).repartition(4), **settings)
    assert sorted(tuple(r) for r in got.collect()) == brute_aligned(rows)


def test_identity_map_has_the_same_bytes():
    tools = alignment.Tokenizers(*map(public_tokenizers.path, (alignment.FIRST, alignment.SECOND)))
    known = [(a, b) for a, b in enumerate(tools.identity.tolist()) if b >= 0]
    assert len(known) > 10_000 and all(tools.a_bytes[a] == tools.b_bytes[b] for a, b in known)
    assert not tools.b.is_byte(int(tools.identity[tools.a_bytes.index(b"A")]))


def test_alignment_odd_rows(odd_docs, make_docs):
    got = alignment.compared(odd_docs).collect()
    assert len(got) == 12 and all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in got)
    assert sum(r["n_a"] == 0 for r in got) == 3                 # two null texts and an empty one
    assert alignment.compared(make_docs([])).collect() == []


# ---- audit

def brute_audit(rows, labels):
    good, bad = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
             "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
             "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        fails.append((i, part or "", {k for k in f if f[k]}))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [i for i, f in mine if letter in f and not f & before]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not f & (before | {letter}) for _, f in mine), len(gone),
                    sum(letter in f and bool(f & before) for _, f in mine), sum(f == {letter} for _, f in mine),
                    sum(i in good for i in gone), sum(i in bad for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(8)
    words = [*PROSE.split(), "AND", "BIG", "$5", "a|b", "#1", "x"]
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 49, 50, 60, 90]))) for _ in range(25)] + [None, "", " \n "]
    texts += [" ".join(f"w{k}" for k in range(80)), " ".join(f"W{k}" for k in range(80))]
    rows = [(rng.randint(0, 60), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(80)]
    return rows + rows[:3] + [(None, texts[0], "a"), (None, None, None), (None, texts[0], "a")]


def test_audit_matches_brute_force(spark, make_docs):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, None, 1), (None, 1, 1), (6, 1, None)]
    docs = make_docs([(i, t, "en", p, 1) for i, t, p in rows], extra=True)
    got = audit.audited(docs.repartition(5), labelled(spark, labels)).collect()
    want = brute_audit(rows, labels)
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want and len(got) == len(want) == 1800


def test_audit_of_an_empty_table(spark, make_docs):
    assert audit.audited(make_docs([]), labelled(spark, [])).collect() == []
    assert audit.audited(make_docs([(1, None)]), labelled(spark, [])).count() == 600
