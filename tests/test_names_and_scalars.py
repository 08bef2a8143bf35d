from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import functions as F

from trailmix import functions as tf

NAMES = ["  Joe's  Real\tBBQ \n", "a b", "x\u0085y", "p\x1cq", "İstanbul  CAFE", "", None, "café 99"]


def test_names_match_python_unicode_rules(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "k int, n string")
    got = {r.k: (r.d, r.m) for r in df.select("k", tf.display_name(F.col("n")).alias("d"),
                                              tf.norm_name(F.col("n")).alias("m")).collect()}
    for k, n in enumerate(NAMES):
        shown = re.sub(r"\s+", " ", ("nan" if n is None else n).strip())
        assert got[k] == (shown, shown.lower())


def test_token_buckets_are_crc32(spark):
    df = spark.createDataFrame([("Joe's BBQ 2",), ("!!!",), (None,)], "n string")
    got = [r.t for r in df.select(tf.hash_tokens(F.col("n")).alias("t")).collect()]
    assert got == [[zlib.crc32(t) % 8192 for t in (b"joe", b"s", b"bbq", b"2")], [0], [0]]


def test_buckets(spark):
    counts = [0, 1, 2, 3, 4, 1023, 1024, 4096]
    df = spark.createDataFrame([(c,) for c in counts], "c bigint")
    assert [r.b for r in df.select(tf.count_bucket(F.col("c")).alias("b")).collect()] == [0, 1, 2, 2, 3, 10, 11, 11]
    means = spark.createDataFrame([(1.25,), (2.25,), (None,), (5.0,), (0.2,)], "m double")
    got = [r.b for r in means.select(tf.star_bucket(F.col("m"), F.lit(3.75)).alias("b")).collect()]
    assert got == [1, 3, 7, 9, 1]           # 2.5 -> 2, 4.5 -> 4, 7.5 -> 8: half to even


def test_dates_clip_draws(spark):
    df = spark.createDataFrame([("2011-07-01",), ("nonsense",)], "d string")
    got = [r.e for r in df.select(tf.epoch_seconds(tf.parse_date(F.col("d"))).alias("e")).collect()]
    assert got == [1309478400, None]
    assert spark.range(1).select(tf.clip(F.lit(7.5)).alias("c")).first().c == 5.0
    one = spark.range(50).select(tf.draw(F.col("id"), "x").alias("d"))
    assert sorted(r.d for r in one.collect()) == sorted(r.d for r in one.repartition(7).collect())


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.u for r in df.select(tf.l2_normalize(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert math.isclose(df.select(tf.dot(F.col("v"), F.col("v")).alias("d")).first().d, 25.0)
