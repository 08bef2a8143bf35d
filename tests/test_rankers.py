from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import blocks, cooccurrence, evaluate, experiments, logs, similarity, toplists

from conftest import rows_of


def matrix(train):
    """(user, item) -> newest rating, item -> name, mean of all rows."""
    rows = sorted(train.collect(), key=lambda r: (r.ts, r.seq))
    cells = {(r.user_id, r.item_id): r.rating for r in rows}
    return cells, {r.item_id: r.name.lower() for r in rows}, sum(r.rating for r in rows) / len(rows)


def brute_lists(score, cells, names, n=10, depth=None):
    out = []
    users, items = sorted({u for u, _ in cells}), sorted({i for _, i in cells})
    for u in users:
        scored = [(-round(s, 9), i) for i in items if (u, i) not in cells and (s := score(u, i)) is not None]
        taken = []
        for _, i in sorted(scored)[:depth]:
            if names[i] not in taken and len(taken) < n:
                taken.append(names[i])
        out += [(u, k + 1, name) for k, name in enumerate(taken)]
    return sorted(out)


def brute_sim(cells, kind, by_user):
    vectors = defaultdict(dict)
    for (u, i), r in cells.items():
        vectors[u if by_user else i][i if by_user else u] = r
    sim = {}
    for a in vectors:
        for b in vectors:
            common = vectors[a].keys() & vectors[b].keys()
            if a == b or not common:
                continue
            if kind == "cosine":
                ab = sum(vectors[a][c] * vectors[b][c] for c in common)
                sim[a, b] = ab / (math.sqrt(sum(vectors[a][c] ** 2 for c in common))
                                  * math.sqrt(sum(vectors[b][c] ** 2 for c in common)))
            else:
                d = sum((vectors[a][c] - vectors[b][c]) ** 2 for c in common)
                sim[a, b] = len(common) / (d + len(common))
    return sim


def brute_knn(cells, sim, mu, k, min_k, by_user):
    def score(u, i):
        near = [((u if by_user else i), (v if by_user else j), r) for (v, j), r in cells.items()
                if (j == i if by_user else v == u)]
        ranked = sorted(((-round(sim[a, b], 9), b, r) for a, b, r in near if (a, b) in sim))[:k]
        if len(ranked) < min_k:
            return mu
        weights = [sim[(u if by_user else i), b] for _, b, _ in ranked]
        return sum(w * r for w, (_, _, r) in zip(weights, ranked)) / sum(weights)
    return score


def test_corated_sums_only(spark):
    ratings = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 5.0), ("b", "x", 4.0), ("c", "z", 1.0)],
                                    "user_id string, item_id string, rating double")
    assert rows_of(similarity.cosine_sim(ratings, "user_id", "item_id")) == [("a", "b", 1.0)]
    assert rows_of(similarity.msd_sim(ratings, "user_id", "item_id")) == [("a", "b", 0.5)]
    assert rows_of(similarity.jaccard_sim(ratings)) == [("x", "y", 0.5)]


def test_popularity_and_rank_based(random_log):
    train = random_log()
    cells, names, _ = matrix(train)
    raters, total = defaultdict(int), defaultdict(float)
    for (_, i), r in cells.items():
        raters[i] += 1
        total[i] += r
    assert rows_of(toplists.popularity(train), "user_id", "rank", "name") == brute_lists(
        lambda u, i: raters[i], cells, names)
    assert rows_of(toplists.rank_based(train, 5), "user_id", "rank", "name") == brute_lists(
        lambda u, i: total[i] / raters[i] if raters[i] >= 5 else None, cells, names)


def test_lists_do_not_depend_on_the_salted_head(random_log, monkeypatch):
    train = random_log()
    want = rows_of(toplists.popularity(train))
    monkeypatch.setattr(toplists, "HEAD", 3)                 # most places lie behind the head
    monkeypatch.setattr(toplists, "SALTS", 5)
    assert rows_of(toplists.popularity(train)) == want


def test_neighbour_lists_with_mean_tier(random_log):
    train = random_log(seed=11)
    cells, names, mu = matrix(train)
    want = brute_lists(brute_knn(cells, brute_sim(cells, "cosine", True), mu, 4, 2, True), cells, names)
    assert rows_of(similarity.user_knn(train, 4, 2), "user_id", "rank", "name") == want
    want = brute_lists(brute_knn(cells, brute_sim(cells, "msd", False), mu, 3, 3, False), cells, names)
    assert rows_of(similarity.item_knn(train, 3, 3), "user_id", "rank", "name") == want


def test_pair_prediction_equals_full_prediction(random_log):
    train = random_log()
    ratings = toplists.rated_pairs(train)
    sim = similarity.cosine_sim(ratings, "user_id", "item_id")
    users, items = train.select("user_id").distinct(), train.select("item_id").distinct()
    pairs = toplists.mask_seen(users.join(items), train)
    full = {(r.user_id, r.item_id): r.score for r in similarity.knn_predict(sim, ratings, 4, 2, "user").collect()}
    mu = logs.global_mean(train).first()["mu"]
    for r in similarity.knn_predict_pairs(sim, ratings, pairs, F.lit(mu), 4, 2, "user").collect():
        assert math.isclose(r.score, full.get((r.user_id, r.item_id), mu), abs_tol=1e-9)


def test_cooccurrence_lists(random_log):
    train = random_log()
    cells, names, _ = matrix(train)
    users = defaultdict(set)
    for u, i in cells:
        users[i].add(u)
    when = {(r.user_id, r.item_id): r.ts for r in sorted(train.collect(), key=lambda r: (r.ts, r.seq))}
    last = max(when.values())
    affinity = {p: cells[p] * 2 ** (-(last - t).total_seconds() / (30 * 86400)) for p, t in when.items()}

    def score(u, i):
        parts = [affinity[u, j] * len(users[i] & users[j]) / len(users[i] | users[j])
                 for (v, j) in cells if v == u and users[i] & users[j]]
        return sum(parts) if parts else None

    assert rows_of(cooccurrence.sar_recommend(train, depth=8), "user_id", "rank", "name") == brute_lists(
        score, cells, names, depth=8)


@pytest.mark.parametrize("block", [4, 100])
def test_blocked_lists_equal_exhaustive_scoring(spark, random_log, block):
    train = random_log()
    cells, names, _ = matrix(train)
    rng = np.random.default_rng(5)
    u_vec = {u: rng.integers(-2, 3, 3).astype(float) for u in {u for u, _ in cells}}
    i_vec = {i: rng.integers(-2, 3, 3).astype(float) for i in names}      # many ties
    users = spark.createDataFrame([(u, [v.tolist()]) for u, v in u_vec.items()], "user_id string, vecs array<array<double>>")
    items = spark.createDataFrame([(i, 0.5, v.tolist()) for i, v in i_vec.items()], "item_id string, bias double, vec array<double>")
    got = blocks.blocked_topn(users, items, train, logs.item_names(train), 4, block=block)
    want = brute_lists(lambda u, i: 0.5 + float(u_vec[u] @ i_vec[i]), cells, names, 4)
    assert rows_of(got, "user_id", "rank", "name") == want
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in i_vec.items()], "item_id string, vec array<double>")
    newest = defaultdict(list)
    for r in sorted(train.collect(), key=lambda r: (r.ts, r.seq)):
        newest[r.user_id].append(r.item_id)
    feed = blocks.homefeed(vectors, train, recent=2, n=4, depth=6, block=block)
    want = brute_lists(lambda u, i: max(float(i_vec[j] @ i_vec[i]) for j in newest[u][-2:]), cells, names, 4, 6)
    assert rows_of(feed, "user_id", "rank", "name") == want


def test_lists_hold_no_seen_items_or_repeated_names(random_log):
    train = random_log(seed=9)
    lists = toplists.popularity(train)
    assert lists.join(train, ["user_id", "item_id"], "left_semi").count() == 0
    assert lists.groupBy("user_id", "name").count().where("count > 1").count() == 0


def test_user_who_saw_everything_has_no_list(make_log):
    train = make_log([("a", "x", "X", 3, 1), ("a", "y", "Y", 3, 2), ("b", "x", "X", 3, 1)])
    assert rows_of(toplists.popularity(train), "user_id", "name") == [("b", "y")]


def test_metrics_count_users_without_lists(spark, make_log):
    test = make_log([("a", "x", "X", 1, 1), ("b", "y", "Y", 1, 1), ("c", "z", "Z", 1, 1), ("d", "q", "Q", 1, 1)])
    recs = spark.createDataFrame([("a", 1, "x"), ("b", 6, "y"), ("c", 11, "z")], "user_id string, rank int, name string")
    row = evaluate.ranking_metrics(recs, test).first()
    assert (row.hr_5, row.hr_10, row.recall_10) == (0.25, 0.5, 0.5)
    assert math.isclose(row.ndcg_10, (1 + 1 / math.log2(7)) / 4)
    assert math.isclose(row.precision_10, row.hr_10 / 10) and math.isclose(row.f1_10, 2 * 0.2 / 1.1 / 4)
    table = evaluate.metrics_table({"m": recs, "none": None, "miss": recs.where("rank > 6")}, test)
    # rank 11 alone is no list of ten: such a model scores zero like one whose table is empty
    assert rows_of(table, "model", "hr_10") == [("m", 0.5), ("miss", 0.0)]
    assert evaluate.catalog_coverage(recs).first().distinct_firsts == 1


def test_precision_recall_and_rating_protocol(spark, random_log):
    preds = spark.createDataFrame([("a", "x", 5.0, 4.0), ("a", "y", 1.0, 3.6), ("a", "z", 4.0, 3.0), ("b", "x", 1.0, 1.0)],
                                  "user_id string, item_id string, true double, est double")
    row = evaluate.precision_recall_at_k(preds).first()
    assert (row.precision, row.recall) == (0.25, 0.25) and math.isclose(row.f1, 0.25)
    assert math.isclose(evaluate.rmse(preds).first().rmse, math.sqrt((1 + 2.6 ** 2 + 1 + 0) / 4))
    made = experiments.rating_predictions(random_log(rows=400), 20, k=3, epochs=2)
    out = {r.model: r for r in experiments.rating_protocol(made).collect()}
    assert set(out) == {"user_knn", "item_knn", "svd"}
    for m, r in out.items():                                  # grouped figures are those of each model alone
        alone = made.where(F.col("model") == m)
        row = evaluate.precision_recall_at_k(alone, ties=("item_id", "ts", "seq")).first()
        assert math.isclose(r.rmse, evaluate.rmse(alone).first().rmse)
        assert (r.precision, r.recall, r.f1) == pytest.approx((row.precision, row.recall, row.f1))


def test_model_selection_stops_and_prefers_first(spark):
    hr = [0.1, 0.3, 0.3, 0.2, 0.2, 0.9]
    runs = spark.createDataFrame([("m", "c1", e + 1, v) for e, v in enumerate(hr)] + [("m", "c2", 1, 0.3)],
                                 "model string, config string, epoch int, hr double")
    row = experiments.select_config(runs, patience=3).first()
    assert (row.config, row.best_epoch, row.stop_epoch, row.best_hr) == ("c1", 2, 5, 0.3)
