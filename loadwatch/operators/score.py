"""Severity-weighted quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwatch.functions.scalars import half_even
from loadwatch.model import OK, WARN, severity_weight


def table_scores(checks: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Score 0 to 100 per table and load date; a missing load scores 0."""
    weight = severity_weight(F.col("severity"))
    credit = F.when(F.col("status") == OK, 1.0).when(F.col("status") == WARN, 0.5).otherwise(0.0)
    scores = checks.groupBy("load_date", "table").agg(
        half_even(100 * F.sum(weight * credit) / F.sum(weight), 1).alias("score"))
    if missing is None:
        return scores
    absent = missing.select("load_date", "table", F.lit(0.0).alias("score"))
    return scores.join(absent, ["load_date", "table"], "left_anti").unionByName(absent)


def unchecked_score(loads: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores completed with 100 for delivered loads that have no check at all."""
    return loads.select("load_date", "table").join(scores, ["load_date", "table"], "left") \
        .withColumn("score", F.coalesce("score", F.lit(100.0)))


def global_scores(scores: DataFrame) -> DataFrame:
    """Mean of the table scores of each day."""
    return scores.groupBy("load_date").agg(F.avg("score").alias("score"))


def score_metrics(scores: DataFrame) -> DataFrame:
    """Scores as long metrics, the global one under the table `_global`."""
    by_table = scores.select("load_date", "table", F.lit("score").alias("metric"), F.col("score").alias("value"))
    overall = global_scores(scores).select("load_date", F.lit("_global").alias("table"), F.lit("score").alias("metric"),
                                           F.col("score").alias("value"))
    return by_table.unionByName(overall)
