"""Queries over the purchase log read the stored one, which has the rows of the plain one."""

from __future__ import annotations

import pytest

from test_growth import write_tables
from trailmix.operators import logs
from trailmix.plans import QUERIES, inputs, models
from trailmix.sources import tables

READERS = ("sliding_examples", "instruction_examples", "chat_messages", "leakage_check", "sample_examples",
           "dataset_summary", "item_name_lookup", "split_anti", "seen_mask", "known_pairs")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tables')}/t"
    write_tables(spark, path)
    return path


@pytest.mark.parametrize("name", READERS)
def test_the_log_is_joined_before_the_query_reads_it(spark, folder, name, monkeypatch):
    """What was stored is replaced by an empty table: nothing of the join is left in the plan."""
    monkeypatch.setattr(inputs, "materialize", lambda df, name="": spark.createDataFrame([], df.schema))
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().analyzed().toString()
    assert "l_orderkey#" not in plan and "o_orderkey#" not in plan


def test_the_stored_log_has_the_rows_of_the_plain_one(spark, folder):
    plain, stored = logs.cohort(tables.purchases(spark, folder)), inputs.stored_rows(spark, folder)[0]
    cols = sorted(plain.columns)
    assert cols == sorted(stored.columns)
    assert sorted(map(str, plain.select(cols).collect())) == sorted(map(str, stored.select(cols).collect()))


def test_jaccard_needs_pairs_and_no_newest_rating(spark, folder, monkeypatch):
    """Which rating of a repeated pair is the newest is neither asked nor are the columns that say so moved."""
    given = []
    monkeypatch.setattr(inputs, "materialize", lambda df, name="": spark.createDataFrame([], df.schema))
    monkeypatch.setattr(models.similarity, "jaccard_sim", lambda pairs: given.append(pairs) or pairs.selectExpr("item_id AS a", "item_id AS b", "1.0D AS sim"))
    QUERIES["item_jaccard_sim"](spark, folder)
    assert given[0].columns == ["user_id", "item_id"]
    assert "Window" not in given[0]._jdf.queryExecution().analyzed().toString()
