"""Secret scans: candidates from patterns, and a random forest that removes the false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import samples
from .spans import spans

_RUN = "A-Za-z0-9_+/.~-"
# Private key blocks, values after a telling name, and long runs of key characters with their padding. A run
# that ends at "=" before more text is a name and no candidate, so its value is one. All linear in the text.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    # two short looks behind come first: the long one is only tried after an assignment
    r"|(?<=[:=\x20\"'])(?<=[:=][\x20]?[\"']?)"
    r"(?<=(?:password|passwd|secret|api_key|apikey|pwd)[\x20]?[:=][\x20]?[\"']?)[^\s\"'<>]{6,}+"
    rf"|(?<![{_RUN}])[{_RUN}]{{16,}}+={{0,2}}+(?![{_RUN}])")
TELLING = r"token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
HARMLESS = r"sha\d*|md5|commit|uuid|guid|checksum|hash|isbn|digest|href|src"
# Frequent word parts. With the corpus' own words they tell by the share they cover words from keys.
WORDS = ("the|and|ing|ion|ent|ter|ati|for|her|tha|ere|all|con|res|ver|one|our|are|not|thi|est|ers|that|with|have|from|"
         "this|will|your|tion|ment|able|ence|ance|ness|less|ful|ous|ive|ity|pre|pro|der|die|und|ein|ich|sch|den|ung|"
         "heit|keit|lich|que|les|des|une|aux|eau|pour|dans|los|las|para|cion|ado|por|el|de|la|en|er|on|an|in|re|st|nd|th|"
         "le|es|ou|ti|is|it|at|to|of|he|ha")
# Words of planted harmless values where the corpus has too few.
POOL = ("user configuration default option number index value session network request response manager handler "
        "service internal document language section history").split()
FEATURES = ("length", "distinct", "class_changes", "digits", "hexadecimal", "covered", "capitals", "path", "telling",
            "assigned", "quoted", "harmless")
TREES, DEPTH, SAMPLE, LEAST = 15, 6, 1500, 0.5
# Words of the corpus dictionary, and planted findings of each format.
DICTIONARY, EACH = 300, 60
# The findings to learn from. Each format is text before, SQL of the value, text after, and whether
# the value is a secret; h is 128 drawn hexadecimal digits, b drawn letters and digits, d drawn decimals, w words.
FORMATS = {
    "hex_token": ('token = "', "substr(h, 1, 40)", '" is set', 1),
    "hex_secret": ("client_secret: ", "substr(h, 1, 64)", " end", 1),
    "hex_bare_key": ("export API_KEY=", "substr(h, 1, 32)", " ", 1),
    "cloud_id": ("use ", "concat('AKIA', upper(substr(translate(b, '01', 'QZ'), 1, 16)))", " for it", 1),
    "cloud_key": ("AWS_SECRET_ACCESS_KEY=", "concat(substr(b, 1, 20), '/', substr(b, 21, 19))", "\\n", 1),
    "short_password": ("password: ", "substr(b, 1, 11)", " thanks", 1),
    "glued_password": ("password=", "concat(split(w, ' ')[0], substr(b, 1, 12))", " ", 1),
    "word_password": ("the pwd = ", "concat(split(w, ' ')[0], substr(d, 1, 4), substr(b, 1, 3))", " here", 1),
    "api_key": ("api_key: ", "substr(b, 1, 24)", " and", 1),
    "forge": ("clone with ", "concat('ghp_', substr(b, 1, 36))", " now", 1),
    "payment": ("key sk: ", "concat('sk_live_', substr(b, 1, 24))", ".", 1),
    "chat": ("slack ", "concat('xoxb-', substr(d, 1, 11), '-', substr(b, 1, 24))", " bot", 1),
    "bearer": ("Authorization: Bearer ", "concat('eyJ', substr(b, 1, 30), '.eyJ', substr(b, 31, 20), '.', substr(h, 1, 20))", "\\n", 1),
    "access_token": ('access_token="', "concat(substr(b, 1, 30), '==')", '"', 1),
    "auth": ("auth_token: '", "substr(b, 1, 32)", "'", 1),
    "address": ("see https://example.org/", "concat(replace(w, ' ', '/'), '/index.html')", " for", 0),
    "site": ("at https://", "concat('www.', replace(w, ' ', '-'), '.example.com/', split(w, ' ')[0])", " now", 0),
    "file": ("open ", "concat('/usr/share/', replace(w, ' ', '/'), '-2.10.', substr(d, 1, 1), '.txt')", " then", 0),
    "snake": ("call ", "replace(w, ' ', '_')", "() first", 0),
    "camel": ("class ", "replace(initcap(w), ' ', '')", " has", 0),
    "long_word": ("so ", "replace(w, ' ', '')", " it", 0),
    "slug": ("title ", "replace(w, ' ', '-')", ", new", 0),
    "assigned_words": ("name = ", "replace(w, ' ', '_')", " ok", 0),
    "token_words": ("token_file: ", "concat('/etc/', replace(w, ' ', '/'))", " ok", 0),
    "placeholder": ("password: ", "split(w, ' ')[0]", " please", 0),
    "placeholder_2": ("api_key = ", "replace(w, ' ', '_')", " here", 0),
    "number": ("order ", "substr(d, 1, 18)", " of", 0),
    "long_number": ("id: ", "substr(d, 1, 24)", " of", 0),
    "stamp": ("log-", "concat('20', substr(d, 1, 6), '-', substr(d, 7, 6), '.', split(w, ' ')[0], '.log')", " at", 0),
    "unique_id": ("uuid ", "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))", " row", 0),
    "digest": ("sha256: ", "substr(h, 1, 64)", " file", 0),
    "commit": ("commit ", "substr(h, 1, 40)", " fixes", 0),
    "checksum": ("md5 = ", "substr(h, 1, 32)", " ok", 0),
    "line": ("above ", "repeat('-', 20 + substr(d, 1, 1))", " below", 0),
    "dots": ("page ", "repeat('.', 20 + substr(d, 1, 1))", " 7", 0),
}
FOUND = ("start", "end", "kind", *FEATURES)


def _described(x, words=()) -> Column:
    """One candidate with the features that the forest sees; ``words`` are the corpus' frequent ones."""
    value, before = x["value"], x["before"]
    size = F.char_length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    known = "|".join([*words, WORDS])
    covered = 1 - F.char_length(F.regexp_replace(value, f"(?i)(?:{known})", "")) / size
    tail = F.substring(before, -24, 24)
    telling, assigned = tail.rlike(f"(?i)(?:{TELLING})"), before.rlike("[:=][\\x20]?[\"'`]?$")
    block, digits = value.startswith("-----BEGIN"), share("[0-9]")
    number = lambda c: c.cast("double")
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), value.alias("value"),
        F.when(block, "private_key").when(assigned & telling, "assigned").otherwise("run").alias("kind"),
        size.alias("length"), (F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0))).alias("distinct"),
        share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]").alias("class_changes"), digits.alias("digits"),
        share("[0-9a-f]").alias("hexadecimal"), covered.alias("covered"), share("[A-Z]").alias("capitals"),
        F.least(F.lit(1.0), share("[/.]") * 4 + number(before.rlike("(?:/|://[^\\s]*)$"))).alias("path"),
        number(telling).alias("telling"), number(assigned).alias("assigned"), number(before.rlike("[\"'`]$")).alias("quoted"),
        number(tail.rlike(f"(?i)(?:{HARMLESS})")).alias("harmless"))


def searched() -> Column:
    """The text, or an empty one where nothing matches: most texts have no candidate, and one search tells."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(text.rlike(CANDIDATE), text).otherwise("")


def candidates(text: Column, words=()) -> Column:
    return F.transform(spans(text, CANDIDATE), lambda x: _described(x, words))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The ``size`` words of 4 to 12 letters that most documents hold, longest first; ties by the alphabet.

    Counted over all documents; the driver receives ``size`` words. Null and empty texts hold none.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("(?<![a-z])[a-z]{4,12}(?![a-z])"), 0))
    held = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    best = [r.word for r in held.orderBy(F.desc("n"), "word").limit(size).collect()]
    return sorted(best, key=lambda w: (-len(w), w))


def planted(spark: SparkSession, words=(), formats=None, each: int = EACH, seed: int = 5) -> DataFrame:
    """(doc_id, format, text, value, label): ``each`` short texts of every format, with a planted value.

    The label is whether the format's value is a secret: it is known from how the text was made and is no rule over
    the forest's inputs. ``words``, or fixed ones, make up paths, names and other harmless values.
    """
    pool = F.array(*[F.lit(w) for w in (list(words) if len(words) > 9 else POOL)])
    draw = lambda k: F.conv(F.substring("h", 1 + 7 * k, 7), 16, 10).cast("bigint")
    rows = None
    for k, name in enumerate(FORMATS if formats is None else formats):
        before, value, after, label = FORMATS[name]
        base = spark.range(0, each, 1, 1).select(F.sha2(F.concat_ws("|", "id", F.lit(name), F.lit(seed)), 512).alias("h"), "id")
        picked = [F.element_at(pool, (draw(j) % F.size(pool) + 1).cast("int")) for j in range(4)]
        base = base.select("id", "h", F.concat_ws(" ", *picked).alias("w"), F.translate(F.base64(F.unhex("h")), "+/=", "x7").alias("b"),
                           F.translate("h", "abcdef", "130527").alias("d"))
        made = base.select((F.col("id") + k * each).alias("doc_id"), F.lit(name).alias("format"), F.expr(value).alias("value"),
                           F.lit(label).alias("label"))
        made = made.withColumn("text", F.concat(F.lit(before.replace("\\n", "\n")), "value", F.lit(after.replace("\\n", "\n"))))
        rows = made if rows is None else rows.unionByName(made)
    return rows


def labelled(texts: DataFrame, words=()) -> DataFrame:
    """(doc_id, format, label, features) of all candidates in planted texts; those apart from the value are harmless."""
    at = F.expr("locate(value, text) - 1")
    rows = texts.select("doc_id", "format", "label", at.alias("_at"), F.char_length("value").alias("_n"),
                        F.explode(candidates(F.col("text"), words)).alias("x"))
    hit = (F.col("x.start") < F.col("_at") + F.col("_n")) & (F.col("_at") < F.col("x.end"))
    return rows.select("doc_id", "format", F.when(hit, F.col("label")).otherwise(0).alias("label"), *[F.col(f"x.{f}").alias(f) for f in FEATURES])


def _as_expression(model, score) -> Column:
    """The forest's mean leaf probability as one expression over a candidate's fields."""
    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            no, yes = list(node.impurityStats().stats())
            return F.lit(float(yes / (no + yes)))
        split = node.split()
        feature = score[FEATURES[split.featureIndex()]]
        return F.when(feature <= float(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = [walk(t._java_obj.rootNode()) for t in model.trees]
    return reduce(lambda a, b: a + b, trees) / float(len(trees))


def forest(findings: DataFrame, sample: int = SAMPLE):
    """A function from a candidate to its probability, from labelled findings (doc_id, label, features).

    About ``sample`` findings of each label, chosen by doc_id, train the forest. ValueError unless both labels occur.
    """
    findings = materialize(findings, "labelled")              # read twice below
    chosen = samples.by_class(findings, "label", F.col("doc_id"), sample)
    rows = materialize(chosen.select(F.col("label").cast("double").alias("y"), *FEATURES), "findings")
    if rows.select("y").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    rows = rows.coalesce(1).sortWithinPartitions("y", *FEATURES)             # a bounded sample, in one order
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "y")
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=11,
                                   featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(data)
    return lambda x: _as_expression(model, x)


def scanned(docs: DataFrame, *columns, findings: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """``columns`` of every row with ``found``: its candidates as (start, end, value, kind, score, secret).

    ``findings`` are labelled findings to train on, by default planted ones of all formats, made with the corpus'
    frequent words. A private key block is a secret by its form. A null text has no candidate.
    """
    words = dictionary(docs)
    probability = forest(labelled(planted(docs.sparkSession, words), words) if findings is None else findings)

    def verdict(x):
        score = probability(x)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["kind"].alias("kind"), score.alias("score"))

    def decided(x):
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["kind"].alias("kind"), x["score"].alias("score"),
                        ((x["score"] >= least) | (x["kind"] == "private_key")).alias("secret"))

    found = F.transform(F.transform(candidates(F.col("_t"), words), verdict), decided)
    return docs.select(*columns, searched().alias("_t")).select(*columns, found.alias("_found"))


def findings(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, start, end, kind, score, secret) of every candidate; false positives have secret = false.

    Null and empty texts and an empty table have no rows; texts of any length are read whole, repeated rows give
    their findings again, and other columns are not read.
    """
    rows = scanned(docs, "doc_id", least=least)
    return rows.select("doc_id", F.explode("_found").alias("x")).select(
        "doc_id", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("start", "end")], "x.kind", F.round("x.score", 6).alias("score"), "x.secret")


def redacted(docs: DataFrame, mark: str = "[SECRET]", least: float = LEAST) -> DataFrame:
    """The documents with every secret replaced by ``mark``; texts without one, and other columns, stay as they are.

    A column ``n_chars``, where there is one, is counted again for changed texts.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    rows = scanned(whole, "_row", "text", least=least)
    changed = F.exists("_found", lambda x: x["secret"])

    def piece(z):
        value = F.when(z["x"]["secret"], mark).otherwise(z["x"]["value"])
        return F.concat(z["p"], F.coalesce(value, F.lit("")))

    # the text between candidates, each followed by its candidate or the mark; the last by nothing
    new = F.array_join(F.transform(F.arrays_zip(F.split("text", CANDIDATE, -1).alias("p"), F.col("_found").alias("x")), piece), "")
    rows = rows.select("_row", F.when(changed, new).otherwise(F.col("text")).alias("_new"), changed.alias("_changed"))
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = F.col("_new")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_changed"), F.char_length("_new")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[column.alias(name) for name, column in out.items()])
