from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import ctr, evaluate, factors, logs, negatives, toplists, training
from trailmix.session import materialize

from conftest import rows_of


@pytest.fixture(scope="module")
def planted(make_log):
    """Two groups of users who stay in their own half of the catalog, plus a few crossers."""
    rng = random.Random(4)
    rows = []
    for u in range(60):
        half = u % 2
        for k, i in enumerate(rng.sample(range(30), 12)):
            item = half * 30 + i
            rows.append((f"u{u:02d}", f"i{item:02d}", f"Name {item}", 5 if i % 2 else 2, k))
    return tuple(materialize(t) for t in logs.leave_one_out(make_log(rows)))


def hits(lists, test):
    return evaluate.ranking_metrics(lists, test).first().hr_10


def test_pairwise_model_beats_popularity(planted):
    train, test = planted
    lists = factors.bpr_lists(train, k=6, iters=12, lr=0.2)
    assert hits(lists, test) > hits(toplists.popularity(train), test)
    assert lists.join(train, ["user_id", "item_id"], "left_semi").count() == 0


def test_factorisation_beats_the_mean(planted):
    train, test = planted
    params = factors.biased_mf(train, k=4, epochs=8, lr=0.15, reg=0.02)
    pred = factors.mf_predict(params, test, train).withColumnRenamed("score", "est")
    both = test.select("user_id", "item_id", F.col("rating").alias("true")).join(pred, ["user_id", "item_id"])
    mu = logs.global_mean(train).first()["mu"]
    mean_error = evaluate.rmse(both.withColumn("est", F.lit(mu))).first().rmse
    assert evaluate.rmse(both).first().rmse < 0.6 * mean_error


def vectors(params):
    return {r.key: np.array(r.vec) for r in params.collect()}


def same(a, b):
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=0, atol=1e-11) for k in a)


@pytest.mark.parametrize("parts, chunk_rows", [(7, 50), (64, 9)])
def test_models_do_not_depend_on_partitions_or_chunks(planted, parts, chunk_rows):
    train, _ = planted
    one, many = train.coalesce(1), train.repartition(parts)
    same(vectors(factors.biased_mf(one, k=3, epochs=2)), vectors(factors.biased_mf(many, k=3, epochs=2, chunk_rows=chunk_rows)))
    same(vectors(factors.bpr(one, k=3, iters=3)), vectors(factors.bpr(many, k=3, iters=3, chunk_rows=chunk_rows)))


def test_a_step_is_the_summed_gradient(spark):
    """One step over repeated rows and a key that half of all rows share, number by number."""
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i) if k % 2 else 0, float(r)) for k, (u, i, r) in enumerate(
        zip(rng.integers(0, 9, 200), rng.integers(0, 12, 200), rng.integers(1, 6, 200)))]
    train = spark.createDataFrame(rows + rows[:20], "user_id int, item_id int, rating double")
    keys = F.array(training.user_key(), training.item_key())
    examples = training.stored_examples(train.select("user_id", "item_id", keys.alias("keys"), F.col("rating").alias("y"),
                                                     F.lit(0).alias("step")), 16)
    idle = spark.createDataFrame([("u:99", [0.5, 1.0, 2.0])], "key string, vec array<double>")
    params = training.initial_rows(examples.needs, 2, 0.3, 1).unionAll(idle)
    start, lr, reg, mu = vectors(params), 0.05, 0.1, 3.0
    got = vectors(training.damped_step(examples, 0, params, training.squared_gradient(mu), lr, reg))
    grad, uses = {k: np.zeros(3) for k in start}, dict.fromkeys(start, 0)
    for u, i, r in rows + rows[:20]:
        p, q = start[f"u:{u}"], start[f"i:{i}"]
        err = r - (mu + p[0] + q[0] + p[1:] @ q[1:])
        grad[f"u:{u}"] += [err, *(err * q[1:])]
        grad[f"i:{i}"] += [err, *(err * p[1:])]
        uses[f"u:{u}"] += 1
        uses[f"i:{i}"] += 1
    want = {k: v if not uses[k] else v + (1 - (1 - lr) ** uses[k]) / uses[k] * (grad[k] - reg * uses[k] * v) for k, v in start.items()}
    same(got, want)
    assert uses["i:0"] > 100 and abs(got["i:0"][0]) < 5          # a key with half of all rows does not overshoot


def test_pairwise_triples_keep_repeated_rows_and_leave_out_known_items(spark):
    rows = [("a", "x")] * 5 + [("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("c", "z"), ("b", "z")]
    train = spark.createDataFrame(rows, "user_id string, item_id string")
    got = factors.triples(train, range(0, 40), 7).collect()
    known = set(rows)
    assert all((r.user_id, r.negative) not in known for r in got) and "c" not in {r.user_id for r in got}
    of_a = [r for r in got if (r.user_id, r.item_id) == ("a", "x")]
    assert 30 < len(of_a) < 110 and {r.negative for r in of_a} == {"z"}      # a third of 5 x 40 draws
    assert rows_of(factors.triples(train.repartition(5), range(0, 40), 7)) == rows_of(factors.triples(train, range(0, 40), 7))


def test_heavy_users_are_split_over_chunks(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("user_id"),
                                   F.col("id").alias("item_id"))
    sizes = training.with_chunks(rows, 50).groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert sizes < 150


@pytest.fixture(scope="module")
def click_examples(planted):
    train, _ = planted
    pairs = train.select("user_id", "item_id")
    users = materialize(ctr.user_fields(train, pairs.select("user_id")))
    items = materialize(ctr.item_fields(train, pairs.select("item_id")))
    negs = negatives.sample_negatives(pairs, pairs, logs.distinct_values(pairs, "item_id"), 2)
    rows = negatives.labelled_union(pairs, negs).select("user_id", "item_id", "label")
    return train, users, items, materialize(ctr.with_fields(rows, users, items))


def test_collapsed_forms_equal_the_field_models(click_examples):
    _, users, items, rows = click_examples
    p = ctr.fm_fit(rows, factors=3, epochs=1)
    w = ctr.wide_fit(rows, epochs=1)
    fm = {r.key: np.array(r.vec) for r in p.collect()}
    wide = {r.key: r.vec[0] for r in w.collect()}
    pairs = rows.select("user_id", "item_id").distinct()
    fields = {(r.user_id, r.item_id): r for r in rows.collect()}
    names = ("u0", "u1", "u2", "i0", "i1", "i2")
    for r in ctr.pair_scores(ctr.fm_sides(p, users, items), pairs).collect():
        x = [fm["bias"]] + [fm[f"{f}:{fields[r.user_id, r.item_id][f]}"] for f in names]
        total = sum(v[1:] for v in x)
        want = sum(v[0] for v in x) + 0.5 * (total @ total - sum(v[1:] @ v[1:] for v in x))
        assert math.isclose(r.score, want, abs_tol=1e-9)
    for r in ctr.pair_scores(ctr.wide_sides(w, users, items), pairs).collect():
        row = fields[r.user_id, r.item_id]
        want = wide["bias"] + sum(wide[f"{f}:{row[f]}"] for f in names) + sum(
            wide[f"x{j}:{row[f'u{a}']}|{row[f'i{b}']}"] for j, (a, b) in enumerate(ctr.CROSSES))
        assert math.isclose(r.score, want, abs_tol=1e-9)


def test_click_models_learn(click_examples, planted):
    train, users, items, rows = click_examples
    params = ctr.fm_fit(rows, factors=6, epochs=10, lr=0.3)
    sides = tuple(materialize(s) for s in ctr.fm_sides(params, users, items))
    scored = ctr.pair_scores(sides, rows.select("user_id", "item_id").distinct()).join(
        rows.groupBy("user_id", "item_id").agg(F.max("label").alias("label")), ["user_id", "item_id"])
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.3
    inputs = materialize(ctr.deep_inputs(rows.select("user_id", "item_id", "label"), params, users, items))
    net = ctr.deep_fit(inputs, 6, (8, 4), 3, 0.01)
    for other in (inputs.coalesce(1), inputs.repartition(7), inputs.repartition(64)):
        again = ctr.deep_fit(other, 6, (8, 4), 3, 0.01)
        assert all(np.allclose(p, q, rtol=0, atol=1e-9) for a, b in zip(net, again) for p, q in zip(a, b))
    lists = ctr.deep_lists(net, sides, params, users, items, train, block=7)
    assert lists.groupBy("user_id").count().agg(F.max("count")).first()[0] == 10
    # brute force: the fitted network on all pairs, none left out
    pairs = users.select("user_id").crossJoin(items.select("item_id"))
    every = ctr.pair_scores(sides, pairs).join(ctr.deep_inputs(pairs, params, users, items), ["user_id", "item_id"]).collect()
    scored = [(r.user_id, r.item_id, r.score + logit(net, np.array(r.features))) for r in every]
    want = toplists.top_n_names(lists.sparkSession.createDataFrame(scored, "user_id string, item_id string, score double"),
                                train, logs.item_names(train))
    assert rows_of(lists, "user_id", "rank", "item_id") == rows_of(want, "user_id", "rank", "item_id")


def logit(layers, x):
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    return float((x @ layers[-1][0] + layers[-1][1])[0])


def test_network_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    layers, x, y = ctr.first_layers((6, 5, 3, 1), 1), rng.normal(size=(20, 6)), rng.integers(0, 2, 20).astype(float)

    def loss():
        z = np.array([logit(layers, row) for row in x])
        return float(np.sum(np.logaddexp(0, z) - y * z))

    flat, grads = [p for layer in layers for p in layer], ctr.network_gradient(layers, x, y)
    for p, g in zip(flat, grads):
        for at in list(np.ndindex(p.shape))[:6]:
            kept, ends = p[at], []
            for move in (1e-6, -1e-6):
                p[at] = kept + move
                ends.append(loss())
            p[at] = kept
            assert math.isclose((ends[1] - ends[0]) / 2e-6, g[at], abs_tol=1e-5)


def test_field_vocabulary_does_not_overlap(click_examples):
    _, users, items, _ = click_examples
    u, i = ctr.field_offsets(users, items)
    spans = [{r[0] for r in df.select(c).collect()} for df, cols in ((u, ctr.USER_FIELDS), (i, ctr.ITEM_FIELDS)) for c in cols]
    assert all(max(a) < min(b) for a, b in zip(spans, spans[1:]))
