from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmix.operators import logs, sequences, spread

from conftest import rows_of


def skewed(spark, n=600):
    """A third of all rows carry one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"),
                                 F.col("id").alias("v"))


def test_split_join_equals_plain_join(spark):
    left, right = skewed(spark), skewed(spark, 300).withColumnRenamed("v", "w")
    want = rows_of(left.join(right, "k"), "k", "v", "w")
    for piece in (7, 64, 10_000):
        assert rows_of(spread.split_join(left, right, ["k"], piece=piece), "k", "v", "w") == want


def test_split_join_bounds_the_rows_of_a_task_key(spark):
    df = skewed(spark)
    sizes = df.groupBy("k").agg(F.count("*").alias("n"))
    pieces = spread._with_pieces(df, ["k"], sizes.select("k", F.col("n").alias("_ln"), F.col("n").alias("_rn")), 20)
    dealt = pieces.groupBy("k", F.pmod(F.xxhash64("v"), F.col("_lp"))).count()
    assert dealt.agg(F.max("count")).first()[0] < 60       # 214 rows of the hot key in 11 pieces


def test_positions_of_a_long_group(spark):
    df = skewed(spark)
    want = rows_of(df.withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy("v"))), "k", "v", "pos")
    assert rows_of(spread.positions(df, ["k"], ["v"]), "k", "v", "pos") == want
    assert rows_of(spread.positions(df, ["k"], ["v"], dense=True), "k", "v", "pos") == want


def test_blocks_keep_the_preceding_rows(spark):
    df = spread.positions(skewed(spark), ["k"], ["v"])
    plain = df.withColumn("ctx", F.collect_list("v").over(
        W.partitionBy("k").orderBy("pos").rowsBetween(-4, -1)))
    blocks = spread.sequence_blocks(df, halo=4, block=9)
    cut = blocks.withColumn("ctx", F.collect_list("v").over(
        W.partitionBy("k", "block_no").orderBy("pos").rowsBetween(-4, -1))).where(~F.col("is_halo"))
    assert rows_of(cut, "k", "pos", "ctx") == rows_of(plain, "k", "pos", "ctx")


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("s")).repartition(6)
    got = [(r.s, r.idx) for r in spread.global_index(df, [F.col("s")]).orderBy("idx").collect()]
    assert [i for _, i in got] == list(range(500))
    assert [s for s, _ in got] == sorted(s for s, _ in got)


def test_exact_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for n in (0, 1, 137, 1000, 2000):
        assert logs.sample_rows(df, ["k"], n).count() == min(n, 1000)
    split = logs.random_split(df, ["k"], 0.2)
    assert split.where("is_test").count() == 200
    assert rows_of(split) == rows_of(logs.random_split(df.repartition(9), ["k"], 0.2))


def test_results_do_not_depend_on_partitions(spark, random_log):
    log = random_log(rows=300)
    one = rows_of(sequences.sliding_examples(log), "user_id", "pos", "context", "target")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = rows_of(sequences.sliding_examples(log.repartition(5)), "user_id", "pos", "context", "target")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == again


def test_numbered_explodes_in_bounded_steps(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 11), ("e", None)], "k string, n int")
    got = rows_of(spread.numbered(df, F.col("n"), "i", piece=5), "k", "i")
    assert got == [("b", 0)] + [("c", i) for i in range(10)] + [("d", i) for i in range(11)]
