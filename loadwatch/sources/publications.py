"""Manifests of a source, its fingerprint and the dates to validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.functions.scalars import minute_of_day, run_url

MANIFEST_SCHEMA = "run_id string, published_at string, dates array<string>, datasets map<string, bigint>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests at `path` (a file or a folder of them); unreadable ones and those without a time are left out."""
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return parse_manifest(raw)


def parse_manifest(raw: DataFrame) -> DataFrame:
    dates = F.array_sort(F.array_distinct(F.transform("dates", lambda d: F.try_to_date(d))))
    published = F.try_to_timestamp("published_at")
    return (raw.where(published.isNotNull())
            .withColumn("published", published)
            .withColumn("published_date", F.to_date(published))
            .withColumn("published_minute", minute_of_day(published))
            .withColumn("dates", F.filter(F.coalesce(dates, F.array().cast("array<date>")), lambda d: d.isNotNull()))
            .withColumn("dates", F.when(F.size("dates") > 0, F.col("dates"))
                        .otherwise(F.array(F.col("published_date")))))


def fingerprint(spark: SparkSession, manifest: DataFrame | None, paths: list[str]) -> DataFrame:
    """One value that changes with every publication: its time, else the latest file time, else empty."""
    stamps = None
    for p in paths:
        fmt = "csv" if p.lower().endswith(".csv") else "parquet"
        part = spark.read.format(fmt).load(p).select(F.col("_metadata.file_modification_time").alias("t"))
        part = part.agg(F.max("t").alias("t"))
        stamps = part if stamps is None else stamps.unionByName(part)
    by_file = (F.concat(F.lit("mtime:"), F.unix_timestamp(F.max("t")).cast("string"))).alias("by_file")
    files = stamps.agg(by_file) if stamps is not None else spark.range(1).select(F.lit("").alias("by_file"))
    if manifest is None:
        return files.select(F.coalesce("by_file", F.lit("")).alias("fingerprint"))
    latest = manifest.agg(F.max_by("published_at", "published")).scalar()
    return files.select(F.coalesce(latest, F.col("by_file"), F.lit("")).alias("fingerprint"))


def plan_dates(manifest_dates: DataFrame, available: DataFrame | None, processed: DataFrame,
               first_connection: bool) -> DataFrame:
    """Dates (column `load_date`) to validate now.

    The published dates; at the first connection also every available date up to the last published one;
    without those already processed, unless nothing would be left: then the publication repeats them all.
    """
    dates = manifest_dates.select("load_date").where("load_date is not null").distinct()
    if first_connection and available is not None:
        earlier = available.where(F.col("load_date") <= dates.agg(F.max("load_date")).scalar())
        dates = dates.unionByName(earlier.select("load_date")).distinct()
    done = processed.select("load_date").distinct().withColumn("done", F.lit(True))
    marked = dates.join(done, "load_date", "left").withColumn("pending", F.col("done").isNull())
    return marked.where(F.col("pending") | ~marked.agg(F.bool_or("pending")).scalar()).select("load_date")


def publication_log(manifest: DataFrame, url_template: str = "") -> DataFrame:
    """One row per publication: run, time, number and range of dates, rows per dataset, link to the run."""
    return manifest.select(
        "run_id", "published_at", "published_date", "published_minute",
        F.size("dates").alias("n_dates"), F.array_min("dates").alias("first_date"),
        F.array_max("dates").alias("last_date"),
        F.coalesce(F.size(F.map_keys("datasets")), F.lit(0)).alias("n_datasets"),
        F.aggregate(F.coalesce(F.map_values("datasets"), F.array().cast("array<bigint>")),
                    F.lit(0).cast("bigint"), lambda a, v: a + v).alias("dataset_rows"),
        run_url(url_template, F.col("run_id")).alias("run_url"))
