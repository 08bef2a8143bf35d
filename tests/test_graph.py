from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import content, convolve, graph, logs, negatives
from trailmix.session import materialize

from conftest import rows_of


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint")


@pytest.fixture(scope="module")
def small(spark):
    return pairs_of(spark, [(u, i) for u in range(9) for i in range(12) if (u * 5 + i * 7) % 4 == 0])


def test_walks_approach_the_expectation(small):
    n = 400
    visits = materialize(graph.random_walks(small, n, length=5))
    expected = materialize(graph.expected_visits(small, length=5))
    walked = {(r.src, r.dst): r.visits / n for r in visits.collect()}
    exact = {(r.src, r.dst): r.mass for r in expected.collect()}
    assert set(walked) <= set(exact)
    assert max(abs(walked.get(k, 0.0) - v) for k, v in exact.items()) < 0.25
    assert abs(sum(exact.values()) / 12 - 5.0) < 1e-9           # five visits per chain
    fid = {r.k: r for r in graph.walk_fidelity(visits, expected, (3,)).collect()}
    assert fid[3].overlap > 0.6 and 0 < fid[3].mass_covered <= 1


def test_walkers_are_dealt_evenly_and_none_is_lost(spark):
    cases = [(n, deg, f) for n in (1, 2, 7, 30) for deg in (1, 3, 7, 11) for f in range(deg)]
    rows = spark.createDataFrame(cases, "n bigint, deg bigint, f bigint")
    got = {}
    for r in graph._dealt(rows, "n", "deg", "f", "place", "share").collect():
        assert (r.n, r.deg, r.f, r.place) not in got and 1 <= r.place <= r.deg and r.share >= 1
        got[r.n, r.deg, r.f, r.place] = r.share
    for n, deg, f in cases:
        line = [(j * deg + f) // n + 1 for j in range(n)]
        assert all(got.get((n, deg, f, p), 0) == line.count(p) and abs(line.count(p) - n / deg) < 1 for p in range(1, deg + 1))
    for n, deg in {c[:2] for c in cases}:                       # over all draws each place expects the same
        assert all(sum(got.get((n, deg, f, p), 0) for f in range(deg)) == n for p in range(1, deg + 1))


def test_counted_walks_follow_the_expectation_closely(small):
    exact = {(r.src, r.dst): r.mass for r in graph.expected_visits(small, length=6).collect()}
    many = graph.random_walks(small, 1000, length=6)
    walked = {(r.src, r.dst): r.visits for r in many.collect()}
    assert set(walked) == set(exact)
    assert all(sum(v for (s, _), v in walked.items() if s == i) == 6000 for i in {s for s, _ in walked})
    assert max(abs(walked[k] / 1000 - v) for k, v in exact.items()) < 0.05
    mean = dict.fromkeys(exact, 0.0)                            # single chains: no preference after many draws
    for seed in range(3):
        for r in graph.random_walks(small.repartition(1 + 6 * (seed % 2)), 80, length=6, seed=seed).collect():
            mean[r.src, r.dst] += r.visits / 240
    assert max(abs(mean[k] - v) for k, v in exact.items()) < 0.2


def test_expectation_of_a_dense_graph_meets_the_users_in_one_step_only(spark, monkeypatch):
    rows = [(f"u{u}", f"i{i}") for u in range(30) for i in range(6) if (u * 7 + i * 3) % 5]
    joins, real = [], graph.split_join
    monkeypatch.setattr(graph, "split_join", lambda left, right, key, *a: joins.append(key) or real(left, right, key, *a))
    got = {(r.src, r.dst): r.mass for r in graph.expected_visits(spark.createDataFrame(rows, "user_id string, item_id string"), 4).collect()}
    assert joins.count(["user_id"]) == 1
    users, items = defaultdict(list), defaultdict(list)
    for u, i in rows:
        users[u].append(i)
        items[i].append(u)
    for src in items:
        state, total = {src: 1.0}, defaultdict(float)
        for _ in range(4):
            visit = defaultdict(float)
            for i, mass in state.items():
                for u in items[i]:
                    for j in users[u]:
                        visit[j] += mass / len(items[i]) / len(users[u])
            state = {j: v / 2 + (0.5 if j == src else 0.0) for j, v in visit.items()}
            for j, v in visit.items():
                total[j] += v
        assert {d for s, d in got if s == src} == set(total)
        assert all(abs(got[src, j] - v) < 1e-9 for j, v in total.items())


def test_walks_do_not_depend_on_partitions(small):
    first = rows_of(graph.random_walks(small.coalesce(1), 25, length=3), "src", "dst", "visits")
    assert first == rows_of(graph.random_walks(small.repartition(7), 25, length=3), "src", "dst", "visits")


def test_isolated_items_get_a_self_loop(spark):
    pairs = pairs_of(spark, [(1, 1), (1, 2), (2, 3)])
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "item_id bigint")
    nbr = graph.neighborhood(graph.random_walks(pairs, 50), items)
    assert rows_of(nbr, "src", "dst", "alpha") == [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    hops = graph.khop(nbr, spark.createDataFrame([(1,), (4,)], "node bigint"), 2)
    assert rows_of(hops, "node", "hop") == [(1, 0), (2, 1), (4, 0)]


def test_neighbourhood_weights_sum_to_one(small):
    nbr = graph.neighborhood(graph.random_walks(small, 60), logs.distinct_values(small, "item_id"), 4)
    for r in nbr.groupBy("src").agg(F.sum("alpha").alias("s"), F.count("*").alias("n")).collect():
        assert abs(r.s - 1) < 1e-9 and r.n <= 4


def test_negatives_are_unseen_even_for_dense_users(spark):
    rows = [(0, i) for i in range(30)] + [(1, i) for i in range(29)] + [(2, 0)]      # user 0 saw all, user 1 all but one
    pairs = pairs_of(spark, rows)
    items = logs.distinct_values(pairs, "item_id")
    got = negatives.sample_negatives(pairs, pairs, items, 5).collect()
    assert len(got) == 5 * (29 + 1) and len({(r.user_id, r.item_id, r.slot) for r in got}) == len(got)
    assert {r.negative for r in got if r.user_id == 1} == {29}
    assert all((r.user_id, r.negative) not in set(rows) for r in got)
    other = negatives.sample_negatives(pairs, pairs, items, 5, epoch=2).collect()
    assert {(r.slot, r.negative) for r in got if r.user_id == 2} != {(r.slot, r.negative) for r in other if r.user_id == 2}
    both = negatives.labelled_union(pairs, spark.createDataFrame(got))
    assert both.where("label = 0").count() == len(got) and both.where("label = 1").count() == len(rows)


def test_hard_negatives_stay_in_the_band(spark, small):
    visits = graph.random_walks(small, 80)
    items = logs.distinct_values(small, "item_id")
    ranked, hit = graph.ranked_visits(visits), graph.reached(visits, items)
    pairs = spark.createDataFrame([(k, k % 12, (k + 1) % 12) for k in range(40)], "k bigint, q bigint, i bigint")
    rank = {(r.src, r.dst): r["rank"] for r in ranked.collect()}
    reach = {r.src: r.n_hit for r in hit.collect()}
    got = negatives.hard_negatives(ranked, hit, items, pairs, ["k"], 3, (2, 5)).collect()
    assert len(got) == 120
    assert all(2 < rank[r.q, r.negative] <= min(5, reach[r.q]) for r in got if reach[r.q] > 2)
    assert [negatives.hard_count(e) for e in (1, 2, 5, 40)] == [0, 1, 4, 6]


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(6, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "item_id bigint, vec array<double>")
    pairs = negatives.with_batches(spark.createDataFrame([(k, k % 6, (k + 2) % 6) for k in range(12)],
                                                         "k bigint, q bigint, i bigint"), ["k"], 5)
    shared = negatives.batch_items(pairs, vectors, 3)
    rows = pairs.join(shared, "batch").where("negative <> i").collect()
    hinge = [max(0.0, z[r.q] @ z[r.negative] - z[r.q] @ z[r.i] + 0.1) for r in rows]
    assert abs(negatives.margin_loss(vectors, pairs, shared).first().loss - np.mean(hinge)) < 1e-9
    pos = np.mean([-np.log1p(np.exp(-(z[r.q] @ z[r.i]))) for r in pairs.collect()])
    neg = np.mean([-np.log1p(np.exp(z[r.q] @ z[r.negative])) for r in rows])
    assert abs(negatives.xent_loss(vectors, pairs, shared).first().loss + pos + neg) < 1e-9


def test_convolutions_match_numpy(spark):
    rng = np.random.default_rng(2)
    h = rng.normal(size=(4, 3))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(h)], "node bigint, vec array<double>")
    edges = [(0, 1, 0.75), (0, 2, 0.25), (1, 0, 1.0), (2, 3, 0.5), (2, 0, 0.5)]      # node 3 has no neighbours
    nbr = spark.createDataFrame(edges, "src bigint, dst bigint, alpha double")
    weights = convolve.seeded_weights(3, dim=5, hidden=4)
    layer = weights["convs"][0]
    msg = np.maximum(h @ layer["Q"].T + layer["q"], 0)
    for pool in ("importance", "mean", "max"):
        n = np.zeros((4, 4))
        for s in range(3):
            own = [(d, a) for src, d, a in edges if src == s]
            w = np.array([a if pool == "importance" else 1.0 for _, a in own])
            block = np.stack([msg[d] for d, _ in own])
            n[s] = block.max(axis=0) if pool == "max" else (w[:, None] * block).sum(axis=0) / w.sum()
        z = np.maximum(np.hstack([h, n]) @ layer["W"].T + layer["w"], 0)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        got = {r.node: r.vec for r in convolve.convolve(nodes, nbr, layer, pool).collect()}
        assert np.allclose(np.stack([got[i] for i in range(4)]), z)
    out = convolve.embed_catalog(nodes.select(F.col("node").alias("item_id"), "vec"), nbr, weights)
    norms = [np.linalg.norm(r.vec) for r in out.collect()]
    assert len(norms) == 4 and all(abs(x - 1) < 1e-9 for x in norms)


def test_content_blocks(spark):
    items = spark.createDataFrame(
        [(1, "Joe BBQ", "Food; Bars", " Phoenix", 1.0, 5.0, True), (2, "!!", None, None, 3.0, 7.0, None)],
        "item_id bigint, name string, categories string, city string, lat double, lon double, is_open boolean")
    fit = spark.createDataFrame([(7, 1, 4.0)], "user_id bigint, item_id bigint, rating double")
    assert rows_of(content.category_bag(items), "item_id", "id") == [(1, 0), (1, 1), (2, 2)]
    assert rows_of(content.city_index(items)) == [(1, "phoenix", 1), (2, "?", 0)]
    nums = {r.item_id: r for r in content.numeric_features(items, fit).collect()}
    assert abs(nums[1].lat + 1) < 1e-6 and abs(nums[2].lat - 1) < 1e-6
    assert nums[1].star == nums[2].star == 0.8 and nums[2].is_open == 1.0 and nums[1].degree > 0 > nums[2].degree
    vec = {r.item_id: r.vec for r in content.content_vectors(items, fit, dims=(4, 3, 2)).collect()}
    assert len(vec[1]) == len(vec[2]) == 14


def test_many_edges_are_not_sent_to_all_tasks(spark, monkeypatch):
    rng = random.Random(5)
    pairs = spark.createDataFrame(sorted({(f"u{rng.randrange(30)}", f"i{rng.randrange(20)}") for _ in range(200)}),
                                  "user_id string, item_id string")
    plans, stored = [], graph.materialize

    def recorded(df, name="stage"):
        if name == "walkers":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    few = rows_of(graph.random_walks(pairs, 40, 3))
    monkeypatch.setattr(graph, "FEW_EDGES", 100, raising=False)
    monkeypatch.setattr(graph, "materialize", recorded)
    many = rows_of(graph.random_walks(pairs, 40, 3))
    assert many == few and sum(r[2] for r in many) == 40 * 3 * len({r[0] for r in many})
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)
