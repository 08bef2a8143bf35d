"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clip
from ..operators import cooccurrence, evaluate, experiments, factors, logs, similarity, toplists, training
from ..sources import store, tables
from . import fitted_sql, models
from .inputs import MIN_RATERS_TEST, MIN_ROWS_RATING_TEST, stored_split, stored_train
from .registry import longs, part, query, rounded

METRICS = ("hr_5", "ndcg_5", "hr_10", "ndcg_10", "precision_10", "recall_10", "f1_10")


def ranks_sql(lists: str, test: str = "te") -> str:
    return f"""
SELECT t.user_id, min(l.rank) AS r FROM {test} t LEFT JOIN {lists} l
  ON l.user_id = t.user_id AND l.name = lower(t.name) AND l.rank <= 10 GROUP BY t.user_id"""


def metrics_sql(lists: str, test: str = "te", label: str = "") -> str:
    return f"""
SELECT {label} round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 6) AS hr_5,
  round(avg(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_5,
  round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 6) AS hr_10,
  round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_10,
  round(avg(CASE WHEN r <= 10 THEN 0.1::DOUBLE ELSE 0 END), 6) AS precision_10,
  round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 6) AS recall_10,
  round(avg(CASE WHEN r <= 10 THEN 0.2::DOUBLE / 1.1 ELSE 0 END), 6) AS f1_10 FROM ({ranks_sql(lists, test)})"""


@query("recs_io", "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(rank AS INTEGER) AS rank, name FROM pop_lists")
def recs_io(spark, d):
    path = store.scratch_path(spark, "recs")
    fit = stored_train(spark, d)
    store.write_recs(toplists.popularity(fit), path, users=fit)
    return store.read_recs(spark, path)


@query("metrics_io", metrics_sql("pop_lists"))
def metrics_io(spark, d):
    path = store.scratch_path(spark, "metrics")
    fit, test = stored_split(spark, d)
    store.write_metrics(evaluate.ranking_metrics(toplists.popularity(fit), test), path, digits=6)
    schema = ", ".join(f"{m} double" for m in METRICS)
    return spark.read.schema(schema).json(path)


@query("target_rank", f"SELECT user_id, CAST(r AS INTEGER) AS hit_rank FROM ({ranks_sql('pop_lists')})")
def target_rank(spark, d):
    fit, test = stored_split(spark, d)
    return evaluate.target_rank(toplists.popularity(fit), test)


@query("ranking_metrics", metrics_sql("pop_lists"))
def ranking_metrics(spark, d):
    fit, test = stored_split(spark, d)
    return rounded(evaluate.ranking_metrics(toplists.popularity(fit), test), *METRICS)


@query("metrics_table", "\nUNION ALL\n".join(
    metrics_sql(lists, label=f"'{name}' AS model,") for name, lists in (
        ("popularity", "pop_lists"), ("rank_based", "rank_lists"), ("sar", "sar_lists"))))
def metrics_table(spark, d):
    fit, test = stored_split(spark, d)
    lists = {"popularity": toplists.popularity(fit), "rank_based": toplists.rank_based(fit, MIN_RATERS_TEST),
             "sar": cooccurrence.sar_recommend(fit), "missing": None}
    return rounded(evaluate.metrics_table(lists, test), *METRICS)


@query("catalog_coverage", """
SELECT CAST(count(*) AS BIGINT) AS distinct_names, round(max(n) / (SELECT count(DISTINCT user_id) FROM pop_lists), 6) AS top_name_share,
  CAST(count(*) FILTER (firsts > 0) AS BIGINT) AS distinct_firsts
FROM (SELECT name, count(DISTINCT user_id) AS n, count(*) FILTER (rank = 1) AS firsts FROM pop_lists GROUP BY name)""")
def catalog_coverage(spark, d):
    return rounded(evaluate.catalog_coverage(toplists.popularity(stored_train(spark, d))), "top_name_share")


# Popularity fitted without the validation rows.
part("fit_all", """
SELECT u.user_id, p.item_id, p.score FROM (SELECT DISTINCT user_id FROM fit) u,
  (SELECT item_id, count(*)::DOUBLE AS score FROM fit GROUP BY item_id) p""")
part("fit_nm", "SELECT item_id, lower(arg_max(name, seq)) AS name FROM fit GROUP BY item_id")
part("fit_lists", models.top_sql("fit_all").replace("seen_pairs", "fit").replace("item_nm", "fit_nm"))
part("val_nm", "SELECT user_id, name FROM val")


@query("validation_hr", f"""
SELECT round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 6) AS hr FROM ({ranks_sql('fit_lists', 'val_nm')})""")
def validation_hr(spark, d):
    fit, valid = logs.validation_split(stored_train(spark, d))
    return rounded(evaluate.validation_hr(toplists.popularity(fit), valid), "hr")


@query("split_shift_control", f"""
{metrics_sql('fit_lists', 'val_nm', "'validation' AS step,")}
UNION ALL {metrics_sql('pop_lists', label="'test' AS step,")}""")
def split_shift_control(spark, d):
    fit, test = stored_split(spark, d)
    return rounded(experiments.split_shift(fit, test), *METRICS)


# ---- rating protocol ---------------------------------------------------------------

part("rp_rows", f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS pos FROM inter
WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) >= {MIN_ROWS_RATING_TEST})""")
part("rp_cut", """
SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', user_id, pos, 42))) <= (SELECT round_even(0.2 * count(*), 0) FROM rp_rows) AS is_test
FROM rp_rows""")
part("rp_tr", "SELECT * FROM rp_cut WHERE NOT is_test")
part("rp_mean", "SELECT avg(rating) AS mu FROM rp_tr")
part("rp_trd", """
SELECT user_id, item_id, rating FROM rp_tr QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY seq DESC) = 1""")
part("rp_te", """
SELECT * FROM rp_cut WHERE is_test AND user_id IN (SELECT user_id FROM rp_tr) AND item_id IN (SELECT item_id FROM rp_tr)""")
part("rp_us", """
SELECT x.user_id AS a, y.user_id AS b, sum(x.rating * y.rating) / (sqrt(sum(x.rating * x.rating)) * sqrt(sum(y.rating * y.rating))) AS sim
FROM rp_trd x JOIN rp_trd y ON x.item_id = y.item_id AND x.user_id <> y.user_id GROUP BY 1, 2""")
part("rp_is", """
SELECT x.item_id AS a, y.item_id AS b, count(*) / (sum((x.rating - y.rating) * (x.rating - y.rating)) + count(*)) AS sim
FROM rp_trd x JOIN rp_trd y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY 1, 2""")
part("rp_pred", f"""
SELECT 'user_knn' AS model, t.user_id, t.item_id, t.seq, t.rating AS truth, p.score AS est FROM rp_te t JOIN ({models.pair_sql(
    'rp_us', 'user_id', 'item_id', 40, 6, 'rp_te', 'rp_trd', 'rp_mean')}) p ON p.user_id = t.user_id AND p.item_id = t.item_id
UNION ALL
SELECT 'item_knn' AS model, t.user_id, t.item_id, t.seq, t.rating AS truth, p.score AS est FROM rp_te t JOIN ({models.pair_sql(
    'rp_is', 'item_id', 'user_id', 30, 9, 'rp_te', 'rp_trd', 'rp_mean')}) p ON p.user_id = t.user_id AND p.item_id = t.item_id""")
part("rp_mf", fitted_sql.mf_sql(**factors.MF, seed=1, strata=training.STRATA, name="rp_mf", source="rp_tr"))
part("rp_all", f"""
SELECT * FROM rp_pred UNION ALL
SELECT 'svd', t.user_id, t.item_id, t.seq, t.rating, greatest(0, least(5, mu + p.b + q.b + ({
    fitted_sql.columns(factors.MF["k"], 'p.f# * q.f#', ' + ')})))
FROM rp_te t, rp_mean, rp_mf p, rp_mf q WHERE p.key = 'u:' || t.user_id AND q.key = 'i:' || t.item_id""")
def scored_sql(table: str) -> str:
    """rmse, precision and recall of each model of a table of predictions."""
    return f"""
WITH top AS (
  SELECT model, user_id, any_value(n_rel) AS n_rel, count(*) FILTER (round(est, 9) >= 3.5) AS n_rec,
    count(*) FILTER (round(est, 9) >= 3.5 AND truth >= 3.5) AS n_both FROM (
    SELECT *, count(*) FILTER (truth >= 3.5) OVER (PARTITION BY model, user_id) AS n_rel,
      row_number() OVER (PARTITION BY model, user_id ORDER BY round(est, 9) DESC, item_id, seq) AS rn FROM {table}) WHERE rn <= 10
  GROUP BY model, user_id)
SELECT model, rmse, precision, recall FROM (
  SELECT model, avg(CASE WHEN n_rec > 0 THEN n_both / n_rec ELSE 0 END) AS precision,
    avg(CASE WHEN n_rel > 0 THEN n_both / n_rel ELSE 0 END) AS recall FROM top GROUP BY model)
JOIN (SELECT model, sqrt(avg((truth - est) * (truth - est))) AS rmse FROM {table} GROUP BY model) USING (model)"""


part("rp_scored", scored_sql("rp_pred"))
part("rp_scored_all", scored_sql("rp_all"))
F1_SQL = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


def _protocol(spark, d, *models):
    return experiments.rating_predictions(tables.purchases(spark, d), MIN_ROWS_RATING_TEST, models or experiments.MODELS)


@query("rmse", "SELECT round(rmse, 6) AS rmse FROM rp_scored WHERE model = 'user_knn'")
def rmse(spark, d):
    return rounded(evaluate.rmse(_protocol(spark, d, "user_knn")), "rmse")


@query("precision_recall_at_k", f"""
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1
FROM rp_scored WHERE model = 'item_knn'""")
def precision_recall_at_k(spark, d):
    out = evaluate.precision_recall_at_k(_protocol(spark, d, "item_knn"), ties=("item_id", "ts", "seq"))
    return rounded(out, "precision", "recall", "f1")


@query("rating_protocol", f"""
SELECT model, round(rmse, 6) AS rmse, round(precision, 6) AS precision, round(recall, 6) AS recall, round({F1_SQL}, 6) AS f1
FROM rp_scored_all""")
def rating_protocol(spark, d):
    return rounded(experiments.rating_protocol(_protocol(spark, d)), "rmse", "precision", "recall", "f1")


# ---- run logs ----------------------------------------------------------------------

# A run log taken from the event table: model, seed, epoch and a score in [0, 1].
part("runs", """
SELECT event_type AS model, user_id % 6 AS seed, date_diff('hour', TIMESTAMP '2024-01-01', ts) % 24 + 1 AS epoch,
  round(avg(value) / 1000, 3) AS hr FROM events GROUP BY 1, 2, 3""")
part("runs_best", """
SELECT model, seed, epoch, hr, max(hr) OVER (PARTITION BY model, seed ORDER BY epoch) AS best FROM runs""")


def run_log(spark, d):
    events = tables.table(spark, d, "events")
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return events.groupBy(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(6)).alias("seed"),
                          (F.pmod(hour, F.lit(24)) + 1).alias("epoch")).agg(
        F.round(F.avg("value") / 1000, 3).alias("hr"))


@query("seed_stability", """
SELECT model, CAST(count(*) AS BIGINT) AS seeds, round(avg(hr), 6) AS hr_mean, round(stddev_samp(hr), 6) AS hr_sd,
  round(min(hr), 6) AS hr_min, round(max(hr), 6) AS hr_max, round(avg(hr) * (SELECT count(*) FROM te), 6) AS hits_mean
FROM (SELECT model, seed, max(hr) AS hr FROM runs GROUP BY model, seed) GROUP BY model""")
def seed_stability(spark, d):
    best = run_log(spark, d).groupBy("model", "seed").agg(F.max("hr").alias("hr"))
    out = experiments.seed_stability(best, stored_split(spark, d)[1].agg(F.count("*")).scalar())
    return rounded(out, "hr_mean", "hr_sd", "hr_min", "hr_max", "hits_mean")


@query("model_selection", """
WITH imp AS (SELECT *, coalesce(hr > max(hr) OVER (PARTITION BY model, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
  FROM runs),
last_better AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY model, seed ORDER BY epoch) AS lb,
  row_number() OVER (PARTITION BY model, seed ORDER BY epoch) AS k FROM imp),
since AS (SELECT *, k - max(CASE WHEN better THEN k END) OVER (PARTITION BY model, seed ORDER BY epoch) AS waited FROM last_better),
stop AS (SELECT model, seed, min(k) AS stop_k FROM since WHERE waited >= 8 GROUP BY model, seed),
kept AS (SELECT s.* FROM since s LEFT JOIN stop USING (model, seed) WHERE stop_k IS NULL OR k <= stop_k),
best AS (SELECT model, seed, max(hr) AS hr, arg_max(epoch, (hr, -epoch)) AS epoch, max(epoch) AS stop_epoch FROM kept GROUP BY model, seed)
SELECT model, CAST(seed AS BIGINT) AS config, CAST(epoch AS BIGINT) AS best_epoch, CAST(stop_epoch AS BIGINT) AS stop_epoch, hr AS best_hr
FROM best QUALIFY row_number() OVER (PARTITION BY model ORDER BY hr DESC, seed) = 1""")
def model_selection(spark, d):
    runs = run_log(spark, d).withColumnRenamed("seed", "config")
    return longs(experiments.select_config(runs), "config", "best_epoch", "stop_epoch")
