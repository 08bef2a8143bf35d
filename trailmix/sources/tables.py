"""Interaction logs and item tables taken from warehouse-style parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display_name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def purchases(spark: SparkSession, folder: str, users: DataFrame | None = None) -> DataFrame:
    """Purchase log: user_id, item_id, name, rating, ts, seq.

    ``seq`` is the struct that orders (and identifies) a user's rows of one day. With ``users`` (user_id, last)
    only their rows, and ``is_last``: whether a row's time is the user's ``last``. They meet the orders, which
    are fewer and narrower than the rows.
    """
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    more = [] if users is None else ["is_last"]
    if users is not None:
        orders = (orders.join(users.select(F.col("user_id").alias("o_custkey"), "last"), "o_custkey")
                  .withColumn("is_last", F.col("o_orderdate").eqNullSafe(F.col("last"))).drop("last"))
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return (line.join(orders, line.l_orderkey == orders.o_orderkey)
            .join(part, line.l_partkey == part.p_partkey)
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    display_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"),
                    F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
                    F.col("o_orderdate").alias("ts"),
                    F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             "l_quantity", "l_shipdate").alias("seq"), *more))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Item attributes: item_id, name, categories, city, lat, lon, is_open, seq."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        display_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"),
        F.concat_ws(";", F.replace(F.col("p_name"), F.lit(" "), F.lit(";")), F.col("p_type")).alias("categories"),
        F.col("p_brand").alias("city"), F.col("p_size").cast("double").alias("lat"),
        F.col("p_retailprice").alias("lon"), F.lit(True).alias("is_open"),
        F.col("p_partkey").alias("seq"))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Event log: the item is the number in the event's properties, which must be there; every rating is 1."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "props")
    item = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.raise_error(F.lit("event without an item")).cast("bigint"))
    return (events.select("user_id", item.alias("item_id"),
                          F.concat(F.lit("Item "), item.cast("string")).alias("name"),
                          F.lit(1.0).alias("rating"), "ts", F.col("event_id").alias("seq")))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Item vectors: item_id, vec."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))
