"""Exhaustive scoring, fitted factor models and click models.

The fitted models have no SQL counterpart; their queries use small settings, the defaults
of the operators are the published ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draw
from ..operators import blocks, ctr, factors, logs, negatives, toplists, training
from ..session import materialize
from ..sources import tables
from . import fitted_sql
from .inputs import events_train, stored_train
from .models import LIST, list_columns, top_sql
from .registry import part, query, rounded

# Each iteration is a round of jobs and a level of the statement's recursion; the operator's default is 200.
BPR_TEST = {**factors.BPR, "iters": 40}


# ---- click features ----------------------------------------------------------------

def fields_sql(side: str, fit: str) -> str:
    """Index and buckets of all users (items) of the deduplicated train rows, counted on the table ``fit``."""
    c, col = side[0], f"{side}_id"
    return f"""
SELECT i.{col}, idx AS {c}0, CAST(CASE WHEN n IS NULL THEN 0 ELSE least(length(bin(n)), 11) END AS INTEGER) AS {c}1,
  CAST(greatest(1, least(11, round_even(2 * coalesce(m, (SELECT avg(rating) FROM {fit})), 0) - 1)) AS INTEGER) AS {c}2
FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS idx FROM (SELECT DISTINCT {col} FROM trd)) i
LEFT JOIN (SELECT {col}, count(*) AS n, avg(rating) AS m FROM {fit} GROUP BY {col}) USING ({col})"""


part("fu", fields_sql("user", "fit"))
part("fi", fields_sql("item", "fit"))
part("tu", fields_sql("user", "trd"))
part("ti", fields_sql("item", "trd"))


def _fields(spark, d):
    train = materialize(logs.dedupe_last(stored_train(spark, d)))
    fit = materialize(logs.leave_one_out(train)[0])
    return (train, materialize(ctr.user_fields(fit, train.select("user_id"))),
            materialize(ctr.item_fields(fit, train.select("item_id"))))


def _sides(users, items):
    u = users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), F.col("u0").cast("bigint").alias("f0"),
                     F.col("u1").cast("bigint").alias("f1"), F.col("u2").cast("bigint").alias("f2"))
    i = items.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), F.col("i0").cast("bigint").alias("f0"),
                     F.col("i1").cast("bigint").alias("f1"), F.col("i2").cast("bigint").alias("f2"))
    return u.unionByName(i)


@query("ctr_features", """
SELECT 'user' AS side, user_id AS id, CAST(u0 AS BIGINT) AS f0, u1::BIGINT AS f1, u2::BIGINT AS f2 FROM fu
UNION ALL SELECT 'item' AS side, item_id AS id, CAST(i0 AS BIGINT), i1::BIGINT, i2::BIGINT FROM fi""")
def ctr_features(spark, d):
    _, users, items = _fields(spark, d)
    return _sides(users, items)


@query("field_offsets", """
WITH c AS (SELECT (SELECT count(*) FROM fu) AS nu, (SELECT count(*) FROM fi) AS ni)
SELECT 'user' AS side, user_id AS id, CAST(u0 AS BIGINT) AS f0, CAST(u1 + nu AS BIGINT) AS f1, CAST(u2 + nu + 12 AS BIGINT) AS f2 FROM fu, c
UNION ALL SELECT 'item' AS side, item_id AS id, CAST(i0 + nu + 24 AS BIGINT), CAST(i1 + nu + 24 + ni AS BIGINT), CAST(i2 + nu + 36 + ni AS BIGINT) FROM fi, c""")
def field_offsets(spark, d):
    _, users, items = _fields(spark, d)
    return _sides(*ctr.field_offsets(users, items))


@query("cross_features", """
SELECT user_id, item_id, CAST(u0 * 12 + i1 AS BIGINT) AS x0, CAST(u0 * 12 + i2 + nu * 12 AS BIGINT) AS x1,
  CAST(u1 * 12 + i1 + nu * 24 AS BIGINT) AS x2, CAST(u2 * 12 + i2 + nu * 24 + 144 AS BIGINT) AS x3
FROM trd JOIN fu USING (user_id) JOIN fi USING (item_id), (SELECT count(*) AS nu FROM fu)""")
def cross_features(spark, d):
    train, users, items = _fields(spark, d)
    return ctr.cross_ids(train, users, items)


# ---- exhaustive scoring ------------------------------------------------------------

def _unit(*keys):
    return draw(*keys) / 4294967296.0


def _unit_sql(*keys):
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


# Stand-in factors: three drawn numbers per user and item, and the mean rating as bias.
part("dense_scores", f"""
SELECT u.user_id, i.item_id, i.bias + list_inner_product(u.v, i.v) AS score
FROM (SELECT user_id, [{', '.join(_unit_sql("'u'", 'user_id', str(k)) for k in range(3))}]::DOUBLE[] AS v FROM (SELECT DISTINCT user_id FROM tr)) u,
 (SELECT item_id, avg(rating) AS bias, [{', '.join(_unit_sql("'i'", 'item_id', str(k)) for k in range(3))}]::DOUBLE[] AS v FROM trd GROUP BY item_id) i""")


def _stand_in(train):
    users = train.select("user_id").distinct().select(
        "user_id", F.array(F.array(*[_unit(F.lit("u"), F.col("user_id"), k) for k in range(3)])).alias("vecs"))
    items = logs.item_stats(train).select(
        "item_id", F.col("mean_rating").alias("bias"),
        F.array(*[_unit(F.lit("i"), F.col("item_id"), k) for k in range(3)]).alias("vec"))
    return users, items


@query("blocked_topn", f"SELECT {LIST} FROM ({top_sql('dense_scores')})")
def blocked_topn(spark, d):
    train = stored_train(spark, d)
    users, items = _stand_in(train)
    return list_columns(blocks.blocked_topn(users, items, train, logs.item_names(train), block=1024))


@query("user_item_cross", """
SELECT user_id, item_id, round(score, 9) AS score FROM dense_scores
WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM seen_pairs)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) <= 5""")
def user_item_cross(spark, d):
    from ..operators.spread import first_per_group
    train = stored_train(spark, d)
    users, items = _stand_in(train)
    scored = blocks.blocked_scores(users, items, train, None, 5, block=1024)
    return rounded(first_per_group(scored, ["user_id"], toplists.by_score(), 5), "score", digits=9)


part("feed_recent", """
SELECT user_id, z FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM ckd)
JOIN em_idx USING (item_id) WHERE rn <= 3""")
part("feed_scores", """
SELECT user_id, e.item_id, max(list_inner_product(r.z, e.z)) AS score FROM feed_recent r, em_idx e GROUP BY 1, 2""")


@query("homefeed_rank", f"""
SELECT {LIST} FROM ({top_sql('feed_scores', where_depth='''QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY round(score, 9) DESC, item_id) <= 50''').replace('seen_pairs', 'ckp').replace('item_nm', 'feed_names')})""")
def homefeed_rank(spark, d):
    vectors = materialize(tables.embeddings(spark, d))
    names = vectors.select("item_id", F.concat(F.lit("place "), F.floor(F.col("item_id") / 2).cast("string")).alias("name"))
    return list_columns(blocks.homefeed(vectors, materialize(events_train(spark, d)), names, block=128))


part("feed_names", "SELECT item_id, 'place ' || (item_id // 2) AS name FROM em_idx")


# ---- fitted models -----------------------------------------------------------------

part("mf_fit", fitted_sql.mf_sql(**factors.MF, seed=7, strata=training.STRATA))
part("mf_scores", fitted_sql.factor_scores_sql("mf_fit", factors.MF["k"], "(SELECT avg(rating::DOUBLE) FROM tr)"))


@query("biased_mf", f"SELECT {LIST} FROM ({top_sql('mf_scores')})")
def biased_mf(spark, d):
    return list_columns(factors.biased_mf_lists(stored_train(spark, d), seed=7))


part("bpr_fit", fitted_sql.bpr_sql(**BPR_TEST, seed=7))
part("bpr_scores", fitted_sql.factor_scores_sql("bpr_fit", BPR_TEST["k"]))


@query("bpr_mf", f"SELECT {LIST} FROM ({top_sql('bpr_scores')})")
def bpr_mf(spark, d):
    return list_columns(factors.bpr_lists(stored_train(spark, d), **BPR_TEST, seed=7))


# The click models: negatives for each positive (16 in the operator's default), drawn as by the operator.
CLICK_NEGATIVES, CLICK = 4, {"epochs": ctr.EPOCHS, "lr": ctr.RATE, "reg": 1e-6}
part("trd_pairs", "SELECT user_id, item_id FROM trd")
part("trd_idx", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM trd)")
part("trd_draws", f"""
SELECT p.user_id, p.item_id, slot, CASE WHEN s0.item_id IS NULL THEN a0.item_id WHEN s1.item_id IS NULL THEN a1.item_id END AS negative
FROM trd_pairs p CROSS JOIN range({CLICK_NEGATIVES}) t(slot) CROSS JOIN (SELECT count(*) AS n FROM trd_idx) c
JOIN trd_idx a0 ON a0.idx = {fitted_sql.draw_sql('p.user_id', 'p.item_id', 'slot', 0, 1, 42)} % n
JOIN trd_idx a1 ON a1.idx = {fitted_sql.draw_sql('p.user_id', 'p.item_id', 'slot', 1, 1, 42)} % n
LEFT JOIN trd_pairs s0 ON s0.user_id = p.user_id AND s0.item_id = a0.item_id
LEFT JOIN trd_pairs s1 ON s1.user_id = p.user_id AND s1.item_id = a1.item_id""")
part("trd_free", """
SELECT u.user_id, i.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY u.user_id) AS n
FROM (SELECT DISTINCT user_id FROM trd_draws WHERE negative IS NULL) u, trd_idx i
ANTI JOIN trd_pairs p ON p.user_id = u.user_id AND p.item_id = i.item_id""")
part("trd_negs", f"""
SELECT user_id, negative AS item_id FROM trd_draws WHERE negative IS NOT NULL
UNION ALL SELECT d.user_id, f.item_id FROM trd_draws d JOIN trd_free f ON f.user_id = d.user_id
  AND f.place = {fitted_sql.draw_sql('d.user_id', 'd.item_id', 'slot', 2, 1, 42)} % f.n WHERE d.negative IS NULL""")
part("user_keys", "SELECT *, 'u0:' || u0 AS ku0, 'u1:' || u1 AS ku1, 'u2:' || u2 AS ku2 FROM tu")
part("item_keys", "SELECT *, 'i0:' || i0 AS ki0, 'i1:' || i1 AS ki1, 'i2:' || i2 AS ki2 FROM ti")
FIELDS = ("ku0", "ku1", "ku2", "ki0", "ki1", "ki2")
CROSSED = [f"'x{j}:' || u{a} || '|' || i{b} AS x{j}" for j, (a, b) in enumerate(ctr.CROSSES)]
part("click_examples", f"""
SELECT e.user_id, e.item_id, label, {', '.join(FIELDS)}, {', '.join(CROSSED)}
FROM (SELECT user_id, item_id, 1 AS label FROM trd UNION ALL SELECT user_id, item_id, 0 FROM trd_negs) e
JOIN user_keys USING (user_id) JOIN item_keys USING (item_id)""")
CROSS_NAMES = tuple(f"x{j}" for j in range(len(ctr.CROSSES)))
part("fm_params", fitted_sql.click_sql("fm", "click_examples", FIELDS, ctr.FM_FACTORS, **CLICK, std=ctr.FM_STD, least=training.LEAST,
                                       seed=42, strata=training.STRATA))
part("wide_params", fitted_sql.click_sql("wide", "click_examples", FIELDS + CROSS_NAMES, 0, **CLICK, std=ctr.FM_STD,
                                         least=training.LEAST, seed=42, strata=training.STRATA))


def side_sql(side: str) -> str:
    """A side's weights, products among its own fields, and sums of factors, under the factorisation machine."""
    c, dims = side[0], range(1, ctr.FM_FACTORS + 1)
    inner = " + ".join(f"a.f{d} * b.f{d} + a.f{d} * c.f{d} + b.f{d} * c.f{d}" for d in dims)
    return f"""SELECT {side}_id, a.b + b.b + c.b + {inner} AS c, {', '.join(f'a.f{d} + b.f{d} + c.f{d} AS s{d}' for d in dims)}
FROM {side}_keys JOIN fm_params a ON a.key = k{c}0 JOIN fm_params b ON b.key = k{c}1 JOIN fm_params c ON c.key = k{c}2"""


part("fm_users", side_sql("user"))
part("fm_items", side_sql("item"))
part("fm_scores", f"""
SELECT user_id, item_id, (SELECT b FROM fm_params WHERE key = 'bias') + u.c + i.c
  + {' + '.join(f'u.s{d} * i.s{d}' for d in range(1, ctr.FM_FACTORS + 1))} AS score FROM fm_users u, fm_items i""")
part("wide_buckets", f"""
SELECT user_id, k AS slot, {', '.join(f"coalesce(w{j}.b, 0) AS w{j}" for j in range(len(ctr.CROSSES)))}
FROM tu, range(12) t(k) {' '.join(f"LEFT JOIN wide_params w{j} ON w{j}.key = 'x{j}:' || u{a} || '|' || k" for j, (a, _) in enumerate(ctr.CROSSES))}""")
part("wide_scores", f"""
SELECT u.user_id, i.item_id, (SELECT b FROM wide_params WHERE key = 'bias') + u.c + i.c + a.w0 + a.w2 + b.w1 + b.w3 AS score
FROM (SELECT user_id, a.b + b.b + c.b AS c FROM user_keys JOIN wide_params a ON a.key = ku0 JOIN wide_params b ON b.key = ku1 JOIN wide_params c ON c.key = ku2) u,
  (SELECT item_id, i1, i2, a.b + b.b + c.b AS c FROM item_keys JOIN wide_params a ON a.key = ki0 JOIN wide_params b ON b.key = ki1 JOIN wide_params c ON c.key = ki2) i
JOIN wide_buckets a ON a.user_id = u.user_id AND a.slot = i.i1 JOIN wide_buckets b ON b.user_id = u.user_id AND b.slot = i.i2""")


def _examples(spark, d):
    """Deduplicated train rows, fields counted on them, and their labelled examples."""
    train = materialize(logs.dedupe_last(stored_train(spark, d)))
    users = materialize(ctr.user_fields(train, train.select("user_id")))
    items = materialize(ctr.item_fields(train, train.select("item_id")))
    pairs = train.select("user_id", "item_id")
    negs = negatives.sample_negatives(pairs, pairs, logs.distinct_values(pairs, "item_id"), CLICK_NEGATIVES)
    rows = negatives.labelled_union(pairs, negs).select("user_id", "item_id", "label")
    return train, users, items, materialize(ctr.with_fields(rows, users, items))


@query("fm_ranker", f"SELECT {LIST} FROM ({top_sql('fm_scores')})")
def fm_ranker(spark, d):
    train, users, items, rows = _examples(spark, d)
    return list_columns(ctr.ranker_lists(ctr.fm_sides(ctr.fm_fit(rows), users, items), train))


@query("wide_cross_ranker", f"SELECT {LIST} FROM ({top_sql('wide_scores')})")
def wide_cross_ranker(spark, d):
    train, users, items, rows = _examples(spark, d)
    return list_columns(ctr.ranker_lists(ctr.wide_sides(ctr.wide_fit(rows), users, items), train))


def _deep(spark, d, fit, sides):
    train, users, items, rows = _examples(spark, d)
    params = ctr.fm_fit(rows)
    base = sides(fit(rows, params), users, items)
    inputs = materialize(ctr.deep_inputs(rows.select("user_id", "item_id", "label"), params, users, items))
    net = ctr.deep_fit(inputs)
    return list_columns(ctr.deep_lists(net, base, params, users, items, train))


@query("deep_ranker")
def deep_ranker(spark, d):
    return _deep(spark, d, lambda rows, params: params, ctr.fm_sides)


@query("wide_deep_ranker")
def wide_deep_ranker(spark, d):
    return _deep(spark, d, lambda rows, params: ctr.wide_fit(rows), ctr.wide_sides)
