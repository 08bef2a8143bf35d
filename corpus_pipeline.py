"""A training-corpus pipeline over the documents table.

Five stages, each a call of one operator on all that its predecessor kept. Every stage's result is written
to the shared folder and read again, so a stage never depends on what an executor held before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmix.llm import mixing, packing, quality, secrets, simhash
from trailmix.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the trees reject go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secrets.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, taken once or left out to meet their sources' targets."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that the documents are packed into, one row a piece."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_dedup), ("secret_scans", secret_scans),
          ("mixing_sources", mixed_sources), ("best_fit_packing", best_fit_packing)]

# Fitted trees, SimHash, a fitted forest and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
