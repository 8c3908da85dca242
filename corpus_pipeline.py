"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Quality rules drop rejected documents; SimHash keeps the document of the smallest id of each group of near-duplicates (five-word
shingles, a similarity of 0.8 or more);
decontamination drops documents that hold a benchmark window; secrets are replaced in the text, and `n_chars` with it; mixing
gives the copies of documents that the training mix takes, in training order. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm import decontaminate, mixing, quality, secrets, simhash
from loadwatch.llm.arrays import table
from loadwatch.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rule nor belong to a rejected host."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("secret scans", secret_scan), ("mixing sources to target weights", mixture)]

#: The fingerprints, the randomness tests and the schedule's inverse are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "stage")
    return docs
