"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length.

Folding undoes the usual disguises: letters that look alike, full-width forms, accents, invisible
characters, and digits or signs in place of letters. The lexicon is a fixed list of insults plus words
and word beginnings that labelled documents show to go with the label; a hit counts with its weight,
unless it lies inside an exception phrase. A logistic curve over the weight, the weight by length and the
strongest hit gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Insults in four languages, folded like the texts.
INSULTS = """
asshole bastard bitch bozo clown coward cretin creep crybaby dimwit dipshit disgusting douchebag dumbass
dumb dunce fool freak garbage halfwit idiot imbecile jackass jerk loser lowlife moron nitwit numbskull
parasite pathetic pig pinhead prick psycho retard scum scumbag shithead sleazebag slut stupid subhuman
thug trash twit vermin weirdo whore worthless wretch
abschaum arschloch depp dummkopf hurensohn idiotin miststuck schlampe schwachkopf trottel versager vollidiot wichser
batard connard connasse cretine debile encule imbeciles minable pourriture salaud salope
basura cabron estupido estupida gilipollas hijoputa imbecil inutil pendejo puta
""".split()
# Phrases in which a listed word insults nobody.
EXCEPTIONS = """
trash can; trash cans; trash bin; trash bag; trash bags; trash talk; trash collection; trash pickup; clown fish;
clown car; class clown; circus clown; rodeo clown; pond scum; soap scum; idiot proof; idiot light; idiot box; fool proof;
april fool; april fools; fools gold; guinea pig; pig iron; pig farm; garbage collection; garbage collector; garbage can;
garbage truck; jerk chicken; jerk seasoning; dumb waiter; dumb bell; dumb bells; dumb terminal; deaf and dumb;
not stupid; not a loser; not worthless; no idiot; tax loser; loser bracket; losers bracket; parasite host; control freak;
sympathetic; basura reciclable; cubo de basura
""".replace("\n", " ").split(";")
# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = str.maketrans("абвгдезіјкмнорстухѕԁԛԝαβεζικνορτυχγηωıłøđħŧßʟɑɡɩɪ",
                           "abbrdezijkmhopctyxsdqwabeziknoptuxynwilodhtslagii")
# Digits and signs and the letters they stand for.
DIGITS = str.maketrans("013456789@$!|+", "oieasgtbgasilt")
PRIOR = 4.0                                # weight of a listed insult that the labels say nothing about
SHORTEST, LONGEST = 4, 9                   # letters of a word beginning
LEAST_DOCS, LEAST_SIGMAS, LEAST_RATIO = 3, 3.0, 1.0
SAMPLE, LEXICON = 6000, 20_000             # labelled documents of each kind for the fit; terms of the lexicon
_SIGNS = re.compile("[0-9@$!|+]+")
_HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_GAP = re.compile(r"[\W\d_]+")


def _as_letters(match: re.Match) -> str:
    """Digits and signs inside a word, digits at its end, and digits, @ and $ at its start are letters."""
    text, start, end = match.string, *match.span()
    before, after = text[start - 1:start].isalpha(), text[end:end + 1].isalpha()
    inside = before and after
    at_end = before and not after and match[0].isdigit()
    at_start = after and not before and not set(match[0]) & set("!|+")
    return match[0].translate(DIGITS) if inside or at_end or at_start else match[0]


def folded(text: str) -> str:
    """The words of a text, disguises undone, with one space before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text)).lower().translate(LOOKALIKES)
    text = _GAP.sub(" ", _SIGNS.sub(_as_letters, text)).strip()
    return f" {text} " if text else " "


def terms(word: str) -> list[str]:
    """What a word may be listed as: the whole word, and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1))]


@dataclass
class Lexicon:
    """Weighted terms (a space before; one after as well if the whole word is meant) and exceptions."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = tuple(folded(p) for p in EXCEPTIONS)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions}

    @cached_property
    def machine(self):
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine

    def features(self, text: str | None) -> list[float]:
        """What the curve sees: weights of the hits, by length too, length, strongest hit, any hit.

        Of several terms at one word the longest counts. An empty text has no hits.
        """
        text = folded(text or "")
        hits: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine.iter(text):
            start = end + 1 - length
            if weight is None:
                free.append((start, end))
            elif start not in hits or hits[start][0] < length:
                hits[start] = length, weight
        for start, end in free:
            for at in range(start, end):        # the phrase but for its last space, which begins the next word
                hits.pop(at, None)
        found = [w for _, w in hits.values()]
        words, total = text.count(" ") - 1, float(sum(found))
        return [1.0, math.log1p(total), math.log1p(100 * total / (words + 50)), math.log1p(words) / 5,
                max(found, default=0.0), float(bool(found))]


def pruned(weights: dict[str, float], gain: float = 0.7) -> dict[str, float]:
    """Without terms that say little more than a shorter beginning that is listed already."""
    out: dict[str, float] = {}
    for term in sorted(weights, key=len):
        shorter = [out[term[:k]] for k in range(2, len(term)) if term[:k] in out]
        if not shorter or weights[term] - shorter[-1] >= gain:
            out[term] = weights[term]
    return out


def lexicon(learned: dict[str, float]) -> Lexicon:
    return Lexicon(pruned({f" {w} ": PRIOR for w in INSULTS} | learned))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 100) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


# Where no labels can be learned from: the listed insults with a curve that asks for a few hits.
UNFITTED = np.array([-4.0, 1.0, 1.0, 0.0, 0.3, 0.0])


def _rows(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` turns (all columns but the last as lists, texts) of a batch into rows."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*fn(*(c.to_pylist() for c in batch.columns)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64(),
              "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in schema.split(",")]
    return docs.mapInArrow(run, schema)


def _counted(marks: list, halves: list, texts: list) -> Iterator[tuple]:
    for mark, half, text in zip(marks, halves, texts, strict=True):
        for term in {t for w in set(folded(text or "").split()) for t in terms(w)}:
            yield term, mark, half


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the curve, from labelled documents that are not held out.

    At most ``sample`` documents of each label on average are learned from, equal texts once; where a
    document has several labels, toxic wins. Terms are counted by Spark; at most ``size`` of them, the
    surest, are kept. The curve is fitted to hits of terms that the other half of the sample gave, and
    weighs the two labels as they occur. Without both labels the listed insults stand alone.
    """
    marks = (labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_mark")))
    counts = {r["_mark"]: r["n"] for r in marks.groupBy("_mark").agg(F.count("*").alias("n")).collect()}    # two rows
    if len(counts) < 2:
        return lexicon({}), UNFITTED
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    chosen = marks.where(place < F.when(F.col("_mark") == 1, sample / counts[1]).otherwise(sample / counts[0]))
    known = (docs.select("doc_id", F.col("text").cast("string").alias("_text"))
             .join(F.broadcast(chosen), "doc_id")                                     # 2 x sample rows
             .groupBy(F.sha2("_text", 256)).agg(F.max(F.struct("_mark", "doc_id", "_text")).alias("_r"))
             .select("_r._mark", F.pmod(F.xxhash64("_r.doc_id", F.lit(12)), F.lit(2)).cast("int").alias("_half"), "_r._text"))
    each = {(r["_mark"], r["_half"]): r["n"] for r in known.groupBy("_mark", "_half").agg(F.count("*").alias("n")).collect()}
    occurs = _rows(known, _counted, "term string, mark int, half int").groupBy("term")
    cells = occurs.agg(*[F.count_if((F.col("mark") == m) & (F.col("half") == h)).alias(f"n{m}{h}") for m in (0, 1) for h in (0, 1)])
    parts = {"_0": (0,), "_1": (1,), "_2": (0, 1)}
    for name, halves in parts.items():
        yes, no = (sum((F.col(f"n{m}{h}") for h in halves), F.lit(0.5)) for m in (1, 0))
        ratio = F.log(yes / no * (sum(each.get((0, h), 0) for h in halves) + 1) / (sum(each.get((1, h), 0) for h in halves) + 1))
        sure = ratio / F.sqrt(1 / yes + 1 / no)
        good = (yes > LEAST_DOCS) & (ratio >= LEAST_RATIO) & (sure >= LEAST_SIGMAS)
        cells = cells.withColumn(name, F.when(good, ratio)).withColumn(f"s{name}", F.when(good, sure))
    best = (cells.withColumn("_s", F.greatest(*[f"s{n}" for n in parts])).where("_s is not null")
            .orderBy(F.desc("_s"), "term").limit(size).select("term", *parts).collect())
    first, second, whole = (lexicon({r["term"]: r[n] for r in best if r[n] is not None}) for n in parts)

    def seen(marks: list, halves: list, texts: list) -> list[tuple]:
        return [(m, (second if h == 0 else first).features(t)) for m, h, t in zip(marks, halves, texts, strict=True)]

    found = sorted((r["mark"], r["x"]) for r in _rows(known, seen, "mark int, x array<double>").collect())
    y, x = np.array([m for m, _ in found], float), np.array([x for _, x in found])
    if not 0 < y.sum() < len(y):
        return whole, UNFITTED
    taken = {m: len(list(g)) for m, g in groupby(y)}
    return whole, fit_curve(x, y, np.array([counts[int(m)] / taken[m] for m in y]) * len(y) / sum(counts.values()))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The score is between 0 and 1; a null text is scored as an empty one. ``predicted`` is 1 from
    ``least`` on. Rows without a doc_id are not held out. Repeated rows give repeated scores.
    """
    words, curve = fit(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "held_out", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([words.features(t.as_py()) for t in batch.column(2)]).reshape(-1, len(curve))
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], columns)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("_text"))
    out = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
