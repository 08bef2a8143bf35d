"""Personal data: fixed patterns, and a span classifier trained from weak labels.

Every candidate span gets the votes of four labelers (the strict pattern, a gazetteer, the words before
it, its shape), each for, against or silent. Expectation-maximisation over the table of vote patterns
estimates how reliable each labeler is for each kind, without any truth; a logistic classifier of span
features is then trained on the resulting probabilities and adds spans to those of the fixed patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .spans import apart, spans

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the strict patterns: the same matches, in time linear in the text.
_NAME = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}      # what a text must hold to be searched
# Looser forms, proposed to the classifier only.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z]{2,24}",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
# Gazetteers of domain endings, card issuers and calling codes, and words before a span.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38"
CALLING = r"\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CUES = {"email": "mail|contact|write to", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|pay",
        "phone": "phone|tel|call|mobile|fax"}
AGAINST = r"version|\bv\.?$|isbn|order|serial|\bid\b|page|figure"
ACCURACY, STRENGTH, ROUNDS, LEAST = 0.9, 20.0, 12, 0.9
VOTES = ("regex", "gazetteer", "context", "shape")
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "digits", "separators", "cue", "valid", "after_space")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def _gazetteer(kind: str, value: Column, strict: bool) -> Column:
    if kind == "email":
        return _vote(value.rlike(rf"(?i)(?:\.|[\])]\x20?)(?:{ENDINGS})$"))
    if kind == "card":
        return _vote(_digits(value).rlike(f"^(?:{ISSUERS})"))
    if kind == "phone":
        return _vote(value.rlike(f"^{CALLING}") if strict else value.rlike(r"^\(?[2-9]"))
    return _vote(value.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."))


def _shape(kind: str, value: Column, before: Column) -> Column:
    if kind == "card":
        return _vote(value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"))
    if kind == "phone":
        return _vote(value.rlike(r"^(?:\+|\()"))
    return _vote(F.length(value) <= 254, ~(F.length(value) <= 254) | before.rlike("[A-Za-z0-9.]$"))


def _described(kind: str, strict: bool, x: Column) -> Column:
    """A candidate with its votes and features. Features take few values, so the table of them stays small."""
    value, before = x["value"], x["before"]
    valid = _valid(kind, value) if strict else F.lit(False)
    cue = before.rlike(f"(?i)(?:{CUES[kind]})")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        valid.alias("valid"), (F.when(valid, 1).otherwise(-1) if strict else F.lit(0)).alias("regex"),
        _gazetteer(kind, value, strict).alias("gazetteer"), _vote(cue, before.rlike(f"(?i)(?:{AGAINST})")).alias("context"),
        _shape(kind, value, before).alias("shape"), F.least(F.length(_digits(value)), F.lit(20)).alias("digits"),
        F.least(F.regexp_count(value, F.lit(r"[\x20().-]")), F.lit(6)).alias("separators"),
        cue.cast("int").alias("cue"), (before.rlike("[\\x20\\n]$") | (before == "")).cast("int").alias("after_space"))


def candidates(text: Column) -> tuple[Column, Column]:
    """The spans of the fixed patterns, and all other candidates that touch none of them."""
    def describe(kind, is_strict):
        return lambda x: _described(kind, is_strict, x)

    strict, loose = [], []
    for kind in KINDS:
        hint = text.contains(HINT[kind]) if HINT[kind] else text.rlike("[0-9]")
        found = F.when(hint, F.transform(spans(text, STRICT[kind]), describe(kind, True)))
        strict.append(found)
        if kind in LOOSE:
            hint = text.rlike("(?i)[\\[(]at[\\])]") if kind == "email" else text.rlike("[0-9]{3}[.-][0-9]{4}")
            loose.append(F.when(hint, F.transform(spans(text, LOOSE[kind]), describe(kind, False))))
    none = F.filter(F.transform(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"),
                                                 F.lit("").alias("before"))), lambda x: _described("email", True, x)), lambda x: F.lit(False))
    join = lambda columns: F.concat(*[F.coalesce(c, none) for c in columns])
    return join(strict), join(loose)


def found_in(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of every row with its ``base`` spans and ``more`` candidates, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    strict, loose = candidates(F.col("_text"))
    rows = docs.select(*columns, text.alias("_text")).select("*", strict.alias("_s"), loose.alias("_l")).drop("_text")
    names = [c for c in rows.columns if c not in ("_s", "_l")]
    base = F.filter("_s", lambda x: x["valid"])
    more = apart(F.filter(F.concat("_s", "_l"), lambda x: ~x["valid"]), base)
    return materialize(rows.select(*[F.col(f"`{c}`") for c in names], base.alias("_base"), more.alias("_more")), "spans")


def _product(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, terms)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> Column:
    """Probability that a candidate is personal data, given its votes, as an expression.

    ``patterns`` has one row (kind, votes, n) for each way to vote: at most 4 x 81. A round is one
    aggregate over it. Each labeler starts as right in 9 of 10 votes, and keeps that as ``STRENGTH``
    imagined votes, so the two outcomes cannot change places.
    """
    prior = {k: 0.5 for k in range(len(KINDS))}
    chance = {(k, v, vote, y): (ACCURACY if vote == y else 1 - ACCURACY if vote else 1.0)
              for k in prior for v in VOTES for vote in (-1, 0, 1) for y in (-1, 1)}

    def posterior() -> Column:
        out = F.lit(0.5)
        for k in prior:
            like = {y: _product([F.lit(prior[k] if y > 0 else 1 - prior[k])] + [
                F.when(F.col(v) == 1, chance[k, v, 1, y]).when(F.col(v) == -1, chance[k, v, -1, y]).otherwise(1.0)
                for v in VOTES]) for y in (-1, 1)}
            out = F.when(F.col("kind") == k, like[1] / (like[1] + like[-1])).otherwise(out)
        return out

    for _ in range(rounds):
        q = F.col("q")
        sums = [F.sum(F.when(F.col(v) == vote, F.col("n") * (q if y > 0 else 1 - q)).otherwise(0.0)).alias(f"{v}{vote}{y}")
                for v in VOTES for vote in (-1, 1) for y in (-1, 1)]
        rows = patterns.withColumn("q", posterior()).groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * q).alias("yes"), *sums)
        for row in rows.collect():
            k = row["kind"]
            prior[k] = (row["yes"] + 1) / (row["n"] + 2)
            for v in VOTES:
                for y in (-1, 1):
                    right, wrong = row[f"{v}{y}{y}"] + ACCURACY * STRENGTH, row[f"{v}{-y}{y}"] + (1 - ACCURACY) * STRENGTH
                    chance[k, v, y, y], chance[k, v, -y, y] = right / (right + wrong), wrong / (right + wrong)
    return posterior()


def _features(x) -> dict[str, Column]:
    return {**{f"is_{k}": (x("kind") == i).cast("double") for i, k in enumerate(KINDS)}, "digits": x("digits") / 10.0,
            "separators": x("separators") / 4.0, "cue": x("cue").cast("double"), "valid": x("valid").cast("double"),
            "after_space": x("after_space").cast("double")}


def classifier(found: DataFrame):
    """A function from a candidate to its probability; None if there is no candidate to learn from."""
    fields = ["kind", *VOTES, "digits", "separators", "cue", "valid", "after_space"]
    every = found.select(F.explode(F.concat("_base", "_more")).alias("x")).select(*[F.col(f"x.{f}") for f in fields])
    table = materialize(every.groupBy(*fields).agg(F.count("*").alias("n")), "votes").coalesce(1)   # few ways to look
    patterns = materialize(table.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")), "patterns").coalesce(1)
    if patterns.isEmpty():
        return None
    table = table.withColumn("q", reliabilities(patterns)).select("*", *[c.alias(f"_{k}") for k, c in _features(F.col).items()])
    soft = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("n") * F.col("q")).alias("w")),
                             F.struct(F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("q"))).alias("w"))))
    rows = VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="x").transform(table.withColumn("s", soft)).select("x", "s.y", "s.w")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50).fit(rows.where("w > 1e-6"))
    weights, bias = [float(c) for c in model.coefficients], float(model.intercept)

    def probability(x) -> Column:
        given = _features(lambda name: x[name])
        return 1 / (1 + F.exp(-(bias + sum(given[f] * w for f, w in zip(FEATURES, weights, strict=True)))))

    return probability


def judged(docs: DataFrame, *columns, least: float = LEAST) -> DataFrame:
    """``columns`` of every row with ``base`` spans and ``spans``, all spans, each (kind, start, end) in order.

    A null text is an empty one. Base spans always stay; a candidate is added if its probability is at
    least ``least``. Without candidates nothing is added.
    """
    found = found_in(docs, *columns)
    probability = classifier(found)
    names = [F.col(f"`{c}`") for c in found.columns if c not in ("_base", "_more")]
    more = F.filter("_more", (lambda x: probability(x) >= least) if probability else (lambda x: F.lit(False)))
    slim = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    rows = found.select(*names, slim(F.col("_base")).alias("base"), slim(F.concat("_base", more)).alias("spans"))
    return rows


def listed(spans_: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def reported(docs: DataFrame) -> DataFrame:
    def of(kind):
        return lambda x: x["kind"] == kind

    rows = judged(docs, "doc_id")
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
