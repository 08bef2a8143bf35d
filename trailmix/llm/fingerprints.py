"""Bottom-k sketches of shingle hashes: small, mergeable, and enough to compare documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import global_index
from ..session import materialize
from .words import words

SHINGLE, K = 5, 64
SPAN = float(1 << 64)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct hashes of a text's shingles, ascending.

    A shingle's hash is taken from the hashes of its words. A text of fewer words than a shingle is one
    shingle; a null text or one without words has an empty sketch.
    """
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return _sketch(hashed, k, shingle)


def _sketch(hashed: Column, k: int, shingle: int) -> Column:
    runs = F.arrays_zip(*[F.slice(hashed, i + 1, F.greatest(F.size(hashed) - (shingle - 1), F.lit(0))).alias(f"w{i}")
                          for i in range(shingle)])
    each = F.transform(runs, lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(shingle)]))
    few = F.when(F.size(hashed) > 0, F.array(F.xxhash64(F.array_join(F.transform(hashed, lambda h: h.cast("string")), " "))))
    every = F.when(F.size(hashed) >= shingle, each).otherwise(F.coalesce(few, F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have; exact while there are at most ``k``.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(
        F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    place = (F.element_at(a, -1).cast("double") + SPAN / 2) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Every row's sketch against that of an edited text and that of the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document's text, in descending order of doc_id; after the last comes the first. Only ids, hashes and
    lengths are sorted, by range over the whole table; texts are shuffled once, by id, and of the next
    text only the code points that are needed. A null text is an empty one. Rows with one doc_id follow
    each other in order of a hash of their text, equal rows count as one and get equal results, and
    rows without a doc_id come last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = base.select("doc_id", "tie", F.char_length("text").cast("bigint").alias("n_chars")).groupBy("doc_id", "tie").agg(
        F.max("n_chars").alias("n_chars"))
    placed = materialize(global_index(keys, [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()], "at"), "order")
    count = placed.count()
    following = placed.select(F.col("doc_id").alias("next_id"), F.col("tie").alias("next_tie"),
                              F.pmod(F.col("at") - 1, F.lit(max(1, count))).alias("at"))
    pairs = materialize(placed.join(following, "at").select("doc_id", "tie", "n_chars", "next_id", "next_tie"), "pairs")
    # both joins take the texts by (doc_id, tie), so they share one shuffle
    by_id = [F.col("t.doc_id").eqNullSafe(F.col("p.next_id")), F.col("t.tie") == F.col("p.next_tie")]
    once = base.alias("t")
    half = F.floor(F.col("p.n_chars") / 2).cast("int")
    tails = once.join(pairs.alias("p"), by_id[0] & by_id[1]).select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.tie").alias("tie"), "n_chars", "next_id", "next_tie",
        F.substr(F.col("t.text"), F.lit(1), half).alias("tail")).dropDuplicates(["doc_id", "tie"])
    mine = F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("t.tie") == F.col("n.tie"))
    whole = once.join(tails.alias("n"), mine)
    kept = F.substr(F.col("t.text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    rows = whole.select(F.col("t.doc_id").alias("doc_id"), F.col("t.tie").alias("tie"), "n_chars", "next_id", "next_tie",
                        F.col("t.text").alias("text"), F.concat(kept, F.col("tail")).alias("edit"))
    rows = rows.select("doc_id", "tie", "n_chars", "next_id", "next_tie", F.sha2("edit", 256).alias("edited_sha256"),
                       F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("a"),
                       F.transform(words(F.col("edit")), lambda w: F.xxhash64(w)).alias("b"))
    rows = materialize(rows.select("doc_id", "tie", "n_chars", "next_id", "next_tie", "edited_sha256",
                                   _sketch(F.col("a"), k, shingle).alias("sketch"), _sketch(F.col("b"), k, shingle).alias("edit")), "sketches")
    other = rows.select(F.col("doc_id").alias("o_id"), F.col("tie").alias("o_tie"), F.col("sketch").alias("next")).dropDuplicates(["o_id", "o_tie"])
    out = rows.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_tie") == F.col("o_tie")))
    return out.select("doc_id", "n_chars", "edited_sha256", "sketch", "edit", "next")


def compared(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    rows = edited(docs, k, shingle)
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
                       as_text(F.col("edit")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edit"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next"), k).alias("near_next"))
