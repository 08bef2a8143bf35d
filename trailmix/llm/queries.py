"""The dealt operators as named queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, fingerprints, langid, mixing, packing, pii, quality, secrets, simhash, substrings, toxicity, urls

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_mixing", mixing.MIXED_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(read(spark, folder, "documents"))


@query("op5_url_filters", urls.JUDGED_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(read(spark, folder, "pages"), urls.rule_table(spark))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(read(spark, folder, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.grouped(read(spark, folder, "documents"))


@query("op6_substring_dedup", substrings.REPEATS_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.without_repeats(read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(read(spark, folder, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pii.reported(read(spark, folder, "documents"))


@query("op3_secret_scans")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.findings(read(spark, folder, "documents"))


@query("op13_filter_audit", audit.AUDITED_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audited(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op11_toxicity")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.compared(read(spark, folder, "documents"))
