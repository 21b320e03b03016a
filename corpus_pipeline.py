"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotally.llm import mixing, near_copies, packing, quality, secrets
from chronotally.llm.common import shared_path

#: SQL cannot express shingle hashes with seeded XXH64, least hashes and components, or the dynamic program of the buckets.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A short document is no bad one here: the least number of words is op6's contract."""
    return quality.filter_documents(docs, quality.Limits(min_words=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_copies.dedupe(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked and n_chars follows."""
    return secrets.redact_documents(docs, n_chars="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
