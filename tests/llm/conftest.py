from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees and wonder whether "
         "any of them will ever learn to fly backwards over the quiet river at night")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) or whole rows -> documents; ``extra`` adds columns with names that operators use."""
    def build(rows, extra=False):
        rows = [tuple(r) + (None, None, None)[: 5 - len(r)] if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(rows, SCHEMA)
        if extra:
            docs = docs.selectExpr("*", "1 AS size", "'x' AS target", "2.0D AS score", "true AS kept", "'y' AS fp", "3 AS _text",
                                   "4 AS _row", "5 AS _digest", "6 AS g", "array(1) AS _found", "'z' AS fingerprint", "7 AS component_id")
        return docs

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows, clashing extra columns."""
    return make_docs([
        (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, PROSE, None, None, None), (3, None, "en", "a", 0),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (None, PROSE + " once more", "en", "a", 1), (None, None, None, None, None),
        (7, "word " * 60_000, "en", "c", 300_000), (8, "one two three four", "en", "c", 18), (9, "é ü ñ 漢字", "fr", "c", 9),
        (10, "x" * 100_000, "fr", "c", 100_000)], extra=True)
