from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trailmix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("trailmix-tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Rows (user, item, name, rating, day) -> interaction log; seq is the row's place."""
    schema = "user_id string, item_id string, name string, rating double, ts timestamp_ntz, seq bigint"

    def build(rows):
        start = dt.datetime(2020, 1, 1)
        return spark.createDataFrame(
            [(u, i, n, float(r), start + dt.timedelta(days=day), k) for k, (u, i, n, r, day) in enumerate(rows)],
            schema)

    return build


@pytest.fixture(scope="session")
def random_log(make_log):
    """A seeded random log with repeated pairs, shared names and ties."""
    import random

    def build(users=12, items=25, rows=150, names=15, seed=3):
        rng = random.Random(seed)
        out = []
        for _ in range(rows):
            i = rng.randrange(items)
            out.append((f"u{rng.randrange(users):02d}", f"i{i:02d}", f"Name {i % names}",
                        rng.randint(1, 5), rng.randrange(40)))
        return make_log(out)

    return build


def rows_of(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
