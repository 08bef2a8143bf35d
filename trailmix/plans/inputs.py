"""The logs the named queries start from, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import logs
from ..session import materialize
from ..sources import tables
from .registry import part

# Rank-based lists need a lower limit on the small test catalogs.
MIN_RATERS_TEST = 25
MIN_ROWS_RATING_TEST = 40


def log(spark: SparkSession, folder: str) -> DataFrame:
    return logs.cohort(tables.purchases(spark, folder))


def stored_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log, and its two sides of the split, for queries that read them several times: joined and written once.

    A user's newest row is one of their last day, so only the rows of last days are ranked and told apart.
    """
    users = materialize(logs.cohort_users(tables.purchases(spark, folder)), "users")
    rows = materialize(tables.purchases(spark, folder, users), "log")
    newest = rows.where("is_last").drop("is_last")
    test = materialize(logs.held_out(newest), "test")
    rest = materialize(logs.without_held_out(newest, test), "last_days")
    return rows.drop("is_last"), rows.where("NOT is_last").drop("is_last").unionByName(rest), test


def stored_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return stored_rows(spark, folder)[1:]


def stored_train(spark: SparkSession, folder: str) -> DataFrame:
    return stored_split(spark, folder)[0]


def events_train(spark: SparkSession, folder: str) -> DataFrame:
    return logs.leave_one_out(tables.clicks(spark, folder))[0]


part("inter", """
SELECT o_custkey AS user_id, l_partkey AS item_id, p_name || ' ' || p_brand AS name,
  ceil(l_quantity / 10) AS rating, o_orderdate AS ts,
  row_number() OVER (ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     l_quantity, l_shipdate) AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")
part("coh", """
SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) >= 20)""")
part("coh_rn", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM coh""")
part("tr", "SELECT * EXCLUDE (rn) FROM coh_rn WHERE rn > 1")
part("te", "SELECT * EXCLUDE (rn) FROM coh_rn WHERE rn = 1")
part("trd", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY seq DESC) AS rn
  FROM tr) WHERE rn = 1""")
part("trd_rn", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM trd""")
part("fit", "SELECT * EXCLUDE (rn) FROM trd_rn WHERE rn > 1")
part("val", "SELECT * EXCLUDE (rn) FROM trd_rn WHERE rn = 1")
part("item_nm", """
SELECT item_id, lower(arg_max(name, seq)) AS name FROM tr GROUP BY item_id""")
part("seen_pairs", "SELECT DISTINCT user_id, item_id FROM tr")
part("seqs", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS pos FROM tr""")
part("cat_first", """
SELECT item_id, arg_min(name, seq) AS name, lower(arg_min(name, seq)) AS norm_name FROM coh GROUP BY item_id""")
part("items_raw", """
SELECT p_partkey AS item_id, p_name || ' ' || p_brand AS name,
  replace(p_name, ' ', ';') || ';' || p_type AS categories, p_brand AS city,
  p_size::DOUBLE AS lat, p_retailprice AS lon, true AS is_open FROM part""")
part("click_rows", """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts, event_id AS seq, 1.0 AS rating
FROM events""")
part("ck_rn", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM click_rows""")
part("ck", "SELECT * EXCLUDE (rn) FROM ck_rn WHERE rn > 1")
part("ckp", "SELECT DISTINCT user_id, item_id FROM ck")
