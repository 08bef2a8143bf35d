"""Files between the stages: CSV, parquet and JSON lines with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display_name, parse_date
from ..session import scratch_path  # noqa: F401  (part of this module's interface)

# The columns of a review export that are read.
REVIEW_COLUMNS = ("user_id", "business_id", "business_name", "stars", "date")
ATTRIBUTE_COLUMNS = ("business_id", "business_name", "business_categories", "business_city",
                     "business_latitude", "business_longitude", "business_open")
# Names of one stored list part; a longer history continues in the next part.
LIST_PART = 4096
# Examples in one file.
EXAMPLES_FILE = 500_000

EXAMPLE_SCHEMA = "user_id string, pos bigint, instruction string, input string, output string"
RECS_SCHEMA = "user_id string, recs array<string>, recs_raw array<string>"
CATALOG_SCHEMA = "item_id string, name string, norm_name string"


def _read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text, the wanted ones selected, each row with its place in the files."""
    header = spark.read.option("header", True).csv(path).columns       # reads one line
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return rows.select(*columns, place.alias("seq"))


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV -> user_id, item_id, name, rating, ts, seq (file order)."""
    rows = _read_csv(spark, path, REVIEW_COLUMNS)
    return rows.select("user_id", F.col("business_id").alias("item_id"),
                       display_name(F.col("business_name")).alias("name"),
                       F.col("stars").cast("double").alias("rating"),
                       parse_date(F.col("date")).alias("ts"), "seq")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attribute columns of a review CSV, one row per review."""
    rows = _read_csv(spark, path, ATTRIBUTE_COLUMNS)
    return rows.select(
        F.col("business_id").alias("item_id"), F.col("business_name").alias("name"),
        F.col("business_categories").alias("categories"), F.col("business_city").alias("city"),
        F.col("business_latitude").cast("double").alias("lat"),
        F.col("business_longitude").cast("double").alias("lon"),
        F.col("business_open").cast("boolean").alias("is_open"), "seq")


def write_split(train: DataFrame, test: DataFrame, path: str) -> None:
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")


def write_catalog(items: DataFrame, path: str) -> None:
    (items.select("item_id", "name", "norm_name").write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).option("header", True).option("escape", '"').csv(path)


def write_histories(history: DataFrame, test: DataFrame, path: str) -> None:
    """(user_id, pos, name) as name arrays of at most ``LIST_PART`` entries, and the test names."""
    part = F.floor((F.col("pos") - 1) / LIST_PART).alias("part")
    entries = F.array_sort(F.collect_list(F.struct("pos", "name")))
    parts = (history.groupBy("user_id", part).agg(entries.alias("_e"))
             .select("user_id", "part", F.transform("_e", lambda e: e["name"]).alias("names")))
    parts.write.mode("overwrite").parquet(f"{path}/histories")
    (test.select("user_id", display_name(F.col("name")).alias("name"))
     .write.mode("overwrite").parquet(f"{path}/test_names"))


def read_histories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(user_id, pos, name) and (user_id, name)."""
    parts = spark.read.parquet(f"{path}/histories")
    rows = parts.select("user_id", "part", F.posexplode("names").alias("_p", "name"))
    history = rows.select("user_id", (F.col("part") * LIST_PART + F.col("_p") + 1).alias("pos"), "name")
    return history, spark.read.parquet(f"{path}/test_names")


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON lines; an example repeats most of its neighbour's names, so files are compressed, and each is of bounded size."""
    (examples.select("user_id", "pos", "instruction", "input", "output").write.mode("overwrite")
     .option("compression", "gzip").option("maxRecordsPerFile", EXAMPLES_FILE).json(path))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE_SCHEMA).json(path)


def _as_arrays(lists: DataFrame, out: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("rank", "name")))    # a list is short
    return (lists.groupBy("user_id").agg(entries.alias("_e"))
            .select("user_id", F.transform("_e", lambda e: e["name"]).alias(out)))


def write_recs(recs: DataFrame, path: str, users: DataFrame | None = None,
               raw: DataFrame | None = None) -> None:
    """One JSON line per user; users without a list get an empty one, ``raw`` adds recs_raw."""
    rows = _as_arrays(recs, "recs")
    if raw is not None:
        rows = rows.join(_as_arrays(raw, "recs_raw"), "user_id", "full")
    if users is not None:
        rows = users.select("user_id").distinct().join(rows, "user_id", "left")
    rows = rows.withColumn("recs", F.coalesce("recs", F.array().cast("array<string>")))
    rows.write.mode("overwrite").json(path)


def read_recs(spark: SparkSession, path: str, column: str = "recs") -> DataFrame:
    """user_id, rank, name of the stored lists."""
    return (spark.read.schema(RECS_SCHEMA).json(path)
            .select("user_id", F.posexplode(column).alias("_p", "name"))
            .select("user_id", (F.col("_p") + 1).alias("rank"), "name"))


def write_metrics(metrics: DataFrame, path: str, digits: int | None = None) -> None:
    """Metric rows as JSON lines, rounded when ``digits`` is given."""
    if digits is not None:
        doubles = {f.name for f in metrics.schema if isinstance(f.dataType, T.DoubleType)}
        metrics = metrics.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c)
                                   for c in metrics.columns])
    metrics.write.mode("overwrite").json(path)
