"""Rankers that need no training: popularity, neighbours, co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draw
from ..operators import cooccurrence, logs, similarity, toplists
from ..session import materialize
from .inputs import MIN_RATERS_TEST, stored_split, stored_train
from .registry import longs, part, query, rounded

LIST = "user_id, CAST(rank AS INTEGER) AS rank, name, item_id, round(score, 9) AS score"


def list_columns(df):
    return rounded(df, "score", digits=9)


def top_sql(scored: str, n: int = 10, where_depth: str = "") -> str:
    """Unseen items of a scored (user_id, item_id, score) table -> lists of distinct names."""
    return f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, name, item_id, score
FROM (SELECT s.user_id, n.name, s.item_id, s.score FROM (
        SELECT user_id, item_id, round(score, 9) AS score FROM {scored}
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM seen_pairs)
        {where_depth}) s JOIN item_nm n USING (item_id)
      QUALIFY row_number() OVER (PARTITION BY s.user_id, n.name ORDER BY s.score DESC, s.item_id) = 1)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) <= {n}"""


def depth_sql(depth: int) -> str:
    return (f"QUALIFY row_number() OVER (PARTITION BY user_id "
            f"ORDER BY round(score, 9) DESC, item_id) <= {depth}")


part("pop_scores", "SELECT item_id, count(*)::DOUBLE AS score FROM trd GROUP BY item_id")
part("pop_all", """
SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM tr) u, pop_scores p""")
part("pop_lists", top_sql("pop_all"))
part("rank_all", f"""
SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM tr) u,
  (SELECT item_id, avg(rating) AS score FROM trd GROUP BY item_id HAVING count(*) >= {MIN_RATERS_TEST}) p""")
part("rank_lists", top_sql("rank_all"))


@query("popularity", f"SELECT {LIST} FROM pop_lists")
def popularity(spark, d):
    return list_columns(toplists.popularity(stored_train(spark, d)))


@query("rank_based", f"SELECT {LIST} FROM rank_lists")
def rank_based(spark, d):
    return list_columns(toplists.rank_based(stored_train(spark, d), MIN_RATERS_TEST))


# A user's own items and those of the newest 20 visits of the same item: cheap candidates.
part("cand_rows", """
SELECT user_id, (item_id * 7 + user_id * 13 + k) % (SELECT count(*) FROM part) AS item_id,
  (('0x' || substr(md5(concat_ws('|', user_id, item_id, k)), 1, 8))::BIGINT % 1000) / 1000.0 AS score
FROM trd, range(3) t(k)""")
part("cand_scores", "SELECT user_id, item_id, max(score) AS score FROM cand_rows GROUP BY user_id, item_id")


def candidate_scores(fit, n_parts):
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))
    rows = toplists.rated_pairs(fit).select("user_id", F.col("item_id").alias("src"), k.alias("k"))
    item = F.pmod(F.col("src") * 7 + F.col("user_id") * 13 + F.col("k"), n_parts)
    score = (draw(F.col("user_id"), F.col("src"), F.col("k")) % 1000) / 1000.0
    return rows.select("user_id", item.alias("item_id"), score.alias("score")).groupBy(
        "user_id", "item_id").agg(F.max("score").alias("score"))


def _candidates(spark, d):
    from ..sources.tables import parts
    fit = stored_train(spark, d)
    return fit, candidate_scores(fit, parts(spark, d).agg(F.count("*")).scalar())


@query("top_n_names", f"SELECT {LIST} FROM ({top_sql('cand_scores')})")
def top_n_names(spark, d):
    fit, cands = _candidates(spark, d)
    return list_columns(toplists.top_n_names(cands, fit, logs.item_names(fit)))


@query("top_n_depth_limited", f"SELECT {LIST} FROM ({top_sql('cand_scores', where_depth=depth_sql(30))})")
def top_n_depth_limited(spark, d):
    fit, cands = _candidates(spark, d)
    return list_columns(toplists.top_n_names(cands, fit, logs.item_names(fit), depth=30))


# ---- similarities ------------------------------------------------------------------

part("co_users", """
SELECT x.user_id AS a, y.user_id AS b, sum(x.rating * y.rating) AS ab, sum(x.rating * x.rating) AS aa,
  sum(y.rating * y.rating) AS bb, count(*) AS n FROM trd x JOIN trd y ON x.item_id = y.item_id AND x.user_id < y.user_id
GROUP BY 1, 2""")
part("co_items", """
SELECT x.item_id AS a, y.item_id AS b, sum((x.rating - y.rating) * (x.rating - y.rating)) AS d, count(*) AS n
FROM trd x JOIN trd y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2""")
part("user_sim", "SELECT a, b, ab / (sqrt(aa) * sqrt(bb)) AS sim FROM co_users")
part("item_sim", "SELECT a, b, n / (d + n) AS sim FROM co_items")
part("deg_items", "SELECT item_id, count(*) AS c FROM trd GROUP BY item_id")
part("jac_sim", """
SELECT a, b, n / (x.c + y.c - n) AS sim FROM co_items JOIN deg_items x ON a = x.item_id JOIN deg_items y ON b = y.item_id""")
part("user_sim2", "SELECT a, b, sim FROM user_sim UNION ALL SELECT b, a, sim FROM user_sim")
part("item_sim2", "SELECT a, b, sim FROM item_sim UNION ALL SELECT b, a, sim FROM item_sim")
part("jac_sim2", "SELECT a, b, sim FROM jac_sim UNION ALL SELECT b, a, sim FROM jac_sim")


@query("corated_join", "SELECT a, b, CAST(n AS BIGINT) AS n, ab FROM co_users")
def corated_join(spark, d):
    return similarity.pair_sums(toplists.rated_pairs(stored_train(spark, d)), "user_id", "item_id",
                                F.count("*").alias("n"), F.sum(F.col("ra") * F.col("rb")).alias("ab"))


@query("user_cosine_sim", "SELECT a, b, round(sim, 6) AS sim FROM user_sim")
def user_cosine_sim(spark, d):
    return rounded(similarity.cosine_sim(toplists.rated_pairs(stored_train(spark, d)), "user_id", "item_id"), "sim")


@query("item_msd_sim", "SELECT a, b, round(sim, 6) AS sim FROM item_sim")
def item_msd_sim(spark, d):
    return rounded(similarity.msd_sim(toplists.rated_pairs(stored_train(spark, d)), "item_id", "user_id"), "sim")


@query("item_jaccard_sim", "SELECT a, b, round(sim, 6) AS sim FROM jac_sim")
def item_jaccard_sim(spark, d):
    return rounded(similarity.jaccard_sim(stored_train(spark, d).select("user_id", "item_id").distinct()), "sim")


# ---- neighbour models --------------------------------------------------------------

def knn_sql(sim: str, rows: str, entity: str, other: str, k: int, min_k: int) -> str:
    return f"""
SELECT user_id, item_id, num / den AS score FROM (
  SELECT a AS {entity}, {other}, sum(sim * rating) AS num, sum(sim) AS den, count(*) FILTER (sim > 0) AS cnt FROM (
    SELECT s.a, r.{other}, s.sim, r.rating FROM {sim} s JOIN {rows} r ON r.{entity} = s.b
    QUALIFY row_number() OVER (PARTITION BY s.a, r.{other} ORDER BY round(s.sim, 9) DESC, s.b) <= {k}) GROUP BY 1, 2)
WHERE cnt >= {min_k} AND den > 0"""


part("user_knn_pred", knn_sql("user_sim2", "trd", "user_id", "item_id", 40, 6))
part("item_knn_pred", knn_sql("item_sim2", "trd", "item_id", "user_id", 30, 9))
for _m in ("user_knn", "item_knn"):
    part(f"{_m}_all", f"""
SELECT u.user_id, i.item_id, coalesce(p.score, (SELECT mu FROM tr_mean)) AS score
FROM (SELECT DISTINCT user_id FROM tr) u CROSS JOIN (SELECT DISTINCT item_id FROM tr) i
LEFT JOIN {_m}_pred p ON p.user_id = u.user_id AND p.item_id = i.item_id""")
    part(f"{_m}_lists", top_sql(f"{_m}_all"))


@query("user_knn", f"SELECT {LIST} FROM user_knn_lists")
def user_knn(spark, d):
    return list_columns(similarity.user_knn(stored_train(spark, d)))


@query("item_knn", f"SELECT {LIST} FROM item_knn_lists")
def item_knn(spark, d):
    return list_columns(similarity.item_knn(stored_train(spark, d)))


def pair_sql(sim: str, entity: str, other: str, k: int, min_k: int, test: str = "te", base: str = "trd",
             mean: str = "tr_mean") -> str:
    return f"""
SELECT t.user_id, t.item_id, greatest(0, least(5, coalesce(e.score, (SELECT mu FROM {mean})))) AS score
FROM (SELECT DISTINCT user_id, item_id FROM {test}) t LEFT JOIN (
  SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS score FROM (
    SELECT t.user_id, t.item_id, CASE WHEN r.{entity} = t.{entity} THEN 1.0 ELSE s.sim END AS sim, r.rating
    FROM (SELECT DISTINCT user_id, item_id FROM {test}) t JOIN {base} r ON r.{other} = t.{other}
    LEFT JOIN {sim} s ON s.a = t.{entity} AND s.b = r.{entity}
    WHERE s.sim IS NOT NULL OR r.{entity} = t.{entity}
    QUALIFY row_number() OVER (PARTITION BY t.user_id, t.item_id
      ORDER BY round(CASE WHEN r.{entity} = t.{entity} THEN 1.0 ELSE s.sim END, 9) DESC, r.{entity}) <= {k})
  GROUP BY 1, 2 HAVING count(*) FILTER (sim > 0) >= {min_k} AND sum(sim) > 0) e
ON e.user_id = t.user_id AND e.item_id = t.item_id"""


@query("knn_pair_predict", f"""
SELECT 'user' AS mode, user_id, item_id, round(score, 6) AS score FROM ({pair_sql('user_sim2', 'user_id', 'item_id', 40, 6)})
UNION ALL
SELECT 'item' AS mode, user_id, item_id, round(score, 6) AS score FROM ({pair_sql('item_sim2', 'item_id', 'user_id', 30, 9)})""")
def knn_pair_predict(spark, d):
    fit, test = stored_split(spark, d)
    ratings = materialize(toplists.rated_pairs(fit), "ratings")
    mu = logs.global_mean(fit).scalar()
    asked = {mode: similarity.pairs_asked(ratings, test, mode) for mode in ("user", "item")}
    users = similarity.knn_predict_pairs(similarity.cosine_sim(ratings, "user_id", "item_id", asked["user"]),
                                         ratings, test, mu, 40, 6, "user")
    items = similarity.knn_predict_pairs(similarity.msd_sim(ratings, "item_id", "user_id", asked["item"]),
                                         ratings, test, mu, 30, 9, "item")
    return rounded(users.withColumn("mode", F.lit("user"))
                   .unionByName(items.withColumn("mode", F.lit("item"))), "score")


# ---- co-occurrence -----------------------------------------------------------------

part("sar_aff", """
SELECT user_id, item_id, rating * pow(2.0, -((SELECT max(epoch(ts)) FROM tr) - epoch(ts)) / (30 * 86400.0)) AS affinity FROM trd""")
part("sar_all", """
SELECT user_id, b AS item_id, sum(affinity * sim) AS score FROM sar_aff JOIN jac_sim2 ON a = item_id GROUP BY 1, 2""")
part("sar_lists", top_sql("sar_all", where_depth=depth_sql(30)))


@query("sar_affinity", "SELECT user_id, item_id, round(affinity, 6) + 0.0 AS affinity FROM sar_aff")
def sar_affinity(spark, d):
    return rounded(cooccurrence.sar_affinity(stored_train(spark, d)), "affinity")


@query("sar_rank", f"SELECT {LIST} FROM sar_lists")
def sar_rank(spark, d):
    return list_columns(cooccurrence.sar_recommend(stored_train(spark, d)))
