"""Run named queries on Spark and DuckDB and compare the results row by row.

usage: python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from trailmix.plans import ORACLES, QUERIES  # noqa: E402
from trailmix.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    print(f"{name:28s} {time.time() - start:6.1f}s", end=" ", flush=True)
    if name not in ORACLES:
        return f"rows only ({len(got)})"
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = canonical(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return f"ok ({len(got)})"
    only_got = sorted(set(got) - set(want))[:3]
    only_want = sorted(set(want) - set(got))[:3]
    return f"DIFF rows {len(got)} vs {len(want)}; spark {only_got}; sql {only_want}"


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the other queries
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{time.time() - start:6.1f}s  {result}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
