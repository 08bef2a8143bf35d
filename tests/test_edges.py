"""Cases at the edge: repeats, empty draws, shallow rankings, white space, empty lists, broken splits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import blocks, content, evaluate, graph, logs, negatives, sequences, toplists

from conftest import rows_of


def test_recent_items_count_a_repeated_item_once(make_log):
    log = make_log([("u", "b", "B", 3, 0), ("u", "c", "C", 3, 1), ("u", "a", "A", 3, 2), ("u", "a", "A", 3, 3),
                    ("u", "a", "A", 3, 4)])
    assert rows_of(sequences.recent_items(log, 3), "item_id", "recency") == [("a", 1), ("b", 3), ("c", 2)]
    assert rows_of(sequences.recent_context(log, 2), "context") == [(["A", "A"],)]       # a context keeps repeats


def test_no_slots_give_no_rows(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "user_id bigint, item_id bigint")
    items = spark.createDataFrame([(i,) for i in range(5)], "item_id bigint")
    assert negatives.sample_negatives(pairs, pairs, items, 0).count() == 0
    assert negatives.batch_items(pairs.withColumn("batch", F.lit(0)), items, 0).count() == 0
    queries = spark.createDataFrame([(1, 1, 1, 2)], "user_id bigint, pos bigint, q bigint, i bigint")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "src bigint, dst bigint, rank int")
    n_hit = spark.createDataFrame([(1, 9)], "src bigint, n_hit bigint")
    got = negatives.hard_negatives(ranked, n_hit, items, queries, ["user_id", "pos"], negatives.hard_count(1), (0, 5))
    assert negatives.hard_count(1) == 0 and got.count() == 0
    with pytest.raises(ValueError):
        graph.random_walks(pairs, 0)


@pytest.mark.parametrize("band", [(0, 5), (1, 5), (2, 5)])
def test_ranking_shallower_than_the_band(spark, band):
    items = spark.createDataFrame([(i,) for i in range(5)], "item_id bigint")
    queries = spark.createDataFrame([(1, 1, 1, 2)], "user_id bigint, pos bigint, q bigint, i bigint")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "src bigint, dst bigint, rank int")
    n_hit = spark.createDataFrame([(1, 9)], "src bigint, n_hit bigint")
    got = negatives.hard_negatives(ranked, n_hit, items, queries, ["user_id", "pos"], 4, band).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3]
    if band[0] == 1:
        assert {r.negative for r in got} == {3}


def test_white_space_of_any_kind_is_stripped(spark):
    items = spark.createDataFrame([(1, "\tFood ;\n Bars\u00a0", " Rome\n"), (2, "Food", "rome"), (3, None, None)],
                                  "item_id bigint, categories string, city string")
    cities = {r.item_id: r.city for r in content.city_index(items).collect()}
    assert cities[1] == cities[2] == "rome" and cities[3] == "?"
    assert len({r.id for r in content.city_index(items).where("item_id < 3").collect()}) == 1


def test_a_model_without_a_list_scores_zero(make_log):
    train = make_log([("a", "x", "X", 3, 0), ("b", "y", "Y", 3, 0)])
    test = make_log([("a", "y", "Y", 3, 1), ("b", "x", "X", 3, 1)])
    lists = toplists.popularity(train)
    rows = {r.model: r for r in evaluate.metrics_table({"full": lists, "empty": lists.limit(0), "none": None}, test).collect()}
    assert set(rows) == {"full", "empty"} and rows["full"].hr_10 == 1.0 and rows["empty"].hr_10 == 0.0


def test_split_sizes_are_checked(make_log):
    log = make_log([("a", "x", "X", 3, 0), ("a", "y", "Y", 3, 1), ("b", "x", "X", 3, 0)])
    train, test = logs.leave_one_out(log)
    logs.check_split(log, train, test)
    with pytest.raises(ValueError):
        logs.check_split(log, train, test.limit(1))


def test_best_columns_equal_a_plain_search():
    rng = np.random.default_rng(3)
    code = np.sort(rng.integers(0, 9, 20))
    scores = rng.integers(0, 4, (30, 20)).astype(float)            # many ties
    scores[rng.random((30, 20)) < 0.3] = -np.inf
    scores[0] = -np.inf
    items = np.arange(20)
    rows, cols = blocks._best_columns(scores, code, items, 3)
    for r in range(30):
        best = {}
        for c in range(20):
            if np.isfinite(scores[r, c]) and scores[r, c] > best.get(code[c], (-np.inf, 0))[0]:
                best[code[c]] = (scores[r, c], c)
        want = sorted(best.values(), key=lambda x: (-x[0], x[1]))[:3]
        assert [(scores[r, c], c) for c in cols[rows == r]] == want


def test_popular_nodes_do_not_change_the_expectation(spark, monkeypatch):
    pairs = spark.createDataFrame([(u, i) for u in range(8) for i in range(6) if i == 0 or (u + i) % 3 == 0],
                                  "user_id bigint, item_id bigint")
    whole = {(r.src, r.dst): r.mass for r in graph.expected_visits(pairs, length=3).collect()}
    dealt = graph.split_join
    monkeypatch.setattr(graph, "split_join", lambda a, b, key, l=None, r=None: dealt(a, b, key, l, r, piece=2))
    split = {(r.src, r.dst): r.mass for r in graph.expected_visits(pairs, length=3).collect()}
    assert whole.keys() == split.keys() and all(abs(v - split[k]) < 1e-12 for k, v in whole.items())
