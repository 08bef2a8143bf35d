"""Steps that read every purchase: as many rows, and the same ones, as the plain way, for less moved data."""

from __future__ import annotations

import datetime as dt

import numpy as np

from trailmix.operators import logs, toplists
from trailmix.plans import inputs
from trailmix.session import materialize
from trailmix.sources import tables

from conftest import rows_of

DAY = dt.date(2020, 1, 1)


def write_tables(spark, folder):
    """60 orders of 4 users, with lines without a part, a part that comes twice, an order without a date."""
    orders = [(k, None if k == 59 else k % 4, None if k in (7, 58) else DAY + dt.timedelta(days=k // 8)) for k in range(60)]
    lines = [(k, j, (k * 7 + j * 3) % 12, k % 3, float(1 + (k + j) % 50), DAY) for k in range(60) for j in range(1 + k % 4)]
    parts = [(p, f"part {p % 5}", "Brand") for p in [*range(10), 3]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")


def test_the_stored_split_is_the_plain_split(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    want = logs.leave_one_out(logs.cohort(tables.purchases(spark, folder)))
    got = inputs.stored_split(spark, folder)
    for a, b in zip(want, got):
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    assert got[1].count() == 3          # one user has too few rows


def test_a_users_last_days_alone_are_ranked(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    users = logs.cohort_users(tables.purchases(spark, folder))
    rows = tables.purchases(spark, folder, users)
    assert rows.count() == logs.cohort(tables.purchases(spark, folder)).count()
    assert 0 < rows.where("is_last").count() < rows.count() / 4


def plain_lists(items, blocked, user, n):
    taken, names, out = {i for u, i in blocked if u == user}, set(), []
    for item, name, place in sorted(items, key=lambda r: r[2]):
        if item not in taken and name not in names:
            names.add(name)
            out.append((user, name, item, place))
    return out[:n]


def test_candidates_grow_with_spoiled_names_not_with_history(spark):
    rng = np.random.default_rng(5)
    items = [(k, f"n{k % 30}", k) for k in range(90)]
    # user 0 has taken the far items only, user 1 the first ones, user 2 all but two names, user 3 some
    blocked = [(0, k) for k in range(50, 90)] + [(1, k) for k in range(40)] + [(2, k) for k in range(90) if k % 30 > 1]
    blocked += [(3, int(k)) for k in rng.choice(90, 45, replace=False)]
    table = spark.createDataFrame([(*r[:2], 0.5, r[2]) for r in items], "item_id long, name string, score double, place long")
    users = spark.range(5).withColumnRenamed("id", "user_id")
    rows = materialize(toplists.shared_order_lists(table, users, spark.createDataFrame(blocked, "user_id long, item_id long"), 4))
    assert rows.groupBy("user_id").count().where("user_id in (0, 4)").select("count").distinct().collect() == [(4,)]
    lists = sorted(rows_of(rows, "user_id", "name", "item_id", "place"), key=lambda r: (r[0], r[3]))
    for user in range(5):
        assert [r for r in lists if r[0] == user][:4] == plain_lists(items, blocked, user, 4)
