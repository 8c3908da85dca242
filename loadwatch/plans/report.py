"""Reading the state: summaries, indicators, bands, heatmaps, exports and the log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwatch.functions.scalars import half_even, hhmm
from loadwatch.model import FAIL, OK
from loadwatch.operators.incidents import minutes_open, mttr_hours
from loadwatch.operators.monitors import table_status

LOW_SCORE = 80.0  # fixed value: scores below it are highlighted


# ------------------------------------------------------------------ series
def latest_points(metrics: DataFrame, metric: str, limit: int) -> DataFrame:
    """The last `limit` points of a metric for each table."""
    newest = Window.partitionBy("table").orderBy(F.desc("load_date"))
    return metrics.where(F.col("metric") == metric).withColumn("age", F.row_number().over(newest)) \
        .where(F.col("age") <= limit).select("table", "load_date", "value")


def score_series(metrics: DataFrame, table: str = "_global", limit: int = 60) -> DataFrame:
    """The last scores of a table, or of all of them, flagged when low."""
    points = latest_points(metrics.where(F.col("table") == table), "score", limit)
    return points.select("load_date", F.round("value", 1).alias("score")) \
        .withColumn("low", F.col("score") < LOW_SCORE).orderBy("load_date")


def sparklines(metrics: DataFrame, limit: int = 30) -> DataFrame:
    """Per table, its last scores from the oldest to the newest, as text."""
    points = latest_points(metrics.where(F.col("table") != "_global"), "score", limit)
    ordered = F.sort_array(F.collect_list(F.struct("load_date", half_even(F.col("value"), 1).alias("score"))))
    return points.groupBy("table").agg(F.concat_ws(" ", F.transform(ordered, lambda p: p["score"].cast("string"))).alias("sparkline"))


def metric_bands(metrics: DataFrame, table: str, metric: str, limit: int = 60) -> DataFrame:
    """Value, band and out-of-band flag of a metric by day, the last `limit` days."""
    names = {"value": metric, "lo": f"{metric}:lo", "hi": f"{metric}:hi"}
    picked = [F.max(F.when(F.col("metric") == n, F.col("value"))).alias(a) for a, n in names.items()]
    by_day = metrics.where((F.col("table") == table) & F.col("metric").isin(*names.values())) \
        .groupBy("load_date").agg(*picked)
    outside = F.col("lo").isNotNull() & ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return by_day.orderBy(F.desc("load_date")).limit(limit).withColumn("anomalous", outside).orderBy("load_date")


def heatmap(checks: DataFrame, table: str, limit: int | None = 30) -> DataFrame:
    """Status of every check of a table on its last `limit` days, one row per check and day."""
    own = checks.where(F.col("table") == table)
    if limit:
        days = own.select("load_date").distinct().orderBy(F.desc("load_date")).limit(limit)
        own = own.join(days, "load_date", "left_semi")
    return own.groupBy("check_id", "name", "load_date").agg(F.max_by("status", "check_order").alias("status"))


def heatmap_grid(checks: DataFrame, table: str, days: list[date]) -> DataFrame:
    """The heatmap of the given days with one column per day."""
    cells = heatmap(checks.where(F.col("load_date").isin(days)), table, None)
    return cells.groupBy("check_id", "name").pivot("load_date", days).agg(F.first("status"))


# ----------------------------------------------------------------- summary
def table_summary(specs: DataFrame, arrivals: DataFrame, checks: DataFrame, scores: DataFrame, metrics: DataFrame,
                  expected: DataFrame, loads: DataFrame) -> DataFrame:
    """One row per table of the day in `arrivals`: status, arrival, rows, expected rows, score, checks and sparkline."""
    counted = checks.groupBy("load_date", "table").agg(
        F.count(F.lit(1)).alias("checks_total"), F.count_if(F.col("status") == OK).alias("checks_ok"),
        F.count_if(F.col("kind") == "rule").alias("rules_total"),
        F.sort_array(F.collect_list(F.when(F.col("status") == FAIL, F.struct("check_order", "name")))).alias("failed"))
    key = ["load_date", "table"]
    rows = table_status(arrivals, specs, checks).join(specs.select("table", "title", "owner", "expected_at"), "table") \
        .join(counted, key, "left").join(scores, key, "left").join(loads.select(*key, "row_count"), key, "left") \
        .join(expected, key, "left").join(sparklines(metrics), "table", "left")
    arrived = F.col("arrived_minute").isNotNull()
    return rows.select(
        "load_date", "table", "title", "owner", hhmm(F.col("expected_at")).alias("expected_at"), "status",
        F.when(arrived, hhmm(F.col("arrived_minute"))).alias("arrived_at"),
        F.when(arrived, F.col("row_count")).alias("row_count"), "expected_rows", "score",
        F.coalesce("checks_total", F.lit(0)).alias("checks_total"), F.coalesce("checks_ok", F.lit(0)).alias("checks_ok"),
        F.coalesce("rules_total", F.lit(0)).alias("rules_total"),
        F.concat_ws("; ", F.transform("failed", lambda c: c["name"])).alias("failing"), "sparkline")


def kpi_snapshot(summary: DataFrame, checks: DataFrame, found: DataFrame, as_of: date, as_of_minute: int) -> DataFrame:
    """The day in one row: mean score, tables, open incidents, checks, rows and hours to resolve."""
    day = F.lit(as_of)
    tables = summary.where(F.col("load_date") == day).agg(
        half_even(F.avg("score"), 1).alias("score"), F.count(F.lit(1)).alias("tables_total"),
        F.count("arrived_at").alias("tables_arrived"), F.count_if(F.col("status") == OK).alias("tables_ok"),
        F.count_if(F.col("status") == "missing").alias("tables_missing"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_today"))
    run = checks.where(F.col("load_date") == day).agg(
        F.count(F.lit(1)).alias("checks_today"), F.count_if(F.col("status") == FAIL).alias("checks_failed"))
    aged = minutes_open(found, day, F.lit(as_of_minute)).agg(
        F.count_if(F.col("resolved_date").isNull()).alias("open_incidents"), mttr_hours().alias("mttr_hours"))
    one = F.lit(1).alias("one")
    parts = [p.select("*", one) for p in (tables, run, aged)]  # one row each
    return parts[0].join(parts[1], "one").join(parts[2], "one").select(
        day.alias("load_date"), "score", "tables_total", "tables_arrived", "tables_ok", "tables_missing",
        "open_incidents", "checks_today", "checks_failed", "rows_today", "mttr_hours")


def metrics_export(kpis: DataFrame, summary: DataFrame, prefix: str = "loadwatch") -> DataFrame:
    """Gauges as (position, metric, label, value, line): the day's totals, then score and rows per table."""
    def gauge(position: int, metric: str, value: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(f"{prefix}_{metric}").alias("metric"),
                        F.lit("").alias("label"), value.cast("double").alias("value"))

    totals = kpis.select(F.inline(F.array(
        gauge(0, "quality_score", F.coalesce("score", F.lit(float("nan")))), gauge(1, "open_incidents", F.col("open_incidents")),
        gauge(2, "tables_missing", F.col("tables_missing")), gauge(3, "checks_failed", F.col("checks_failed")))))
    per_table = summary.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f"{prefix}_{name}").alias("metric"), F.col("table").alias("label"),
                 F.col(c).cast("double").alias("value"))
        for i, (name, c) in enumerate((("table_score", "score"), ("table_rows", "row_count")), 4)]))).where("value is not null")
    number = F.when(F.isnan("value"), F.lit("NaN")).when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")) \
        .otherwise(F.col("value").cast("string"))
    label = F.when(F.col("label") == "", F.lit("")).otherwise(F.concat(F.lit('{table="'), "label", F.lit('"}')))
    return totals.unionByName(per_table).withColumn("line", F.concat("metric", label, F.lit(" "), number))


def validation_log(arrivals: DataFrame, specs: DataFrame, checks: DataFrame, loads: DataFrame, story: DataFrame,
                   limit: int | None = 40) -> DataFrame:
    """Events of the monitor, newest first: arrivals, late and missing tables, incidents opened and resolved."""
    counts = checks.groupBy("load_date", "table").agg(
        F.count_if(F.col("status") == FAIL).alias("n_fail"), F.count_if(F.col("kind") == "rule").alias("n_rules"))
    a = arrivals.join(specs.select("table", "expected_at"), "table").join(counts, ["load_date", "table"], "left") \
        .join(loads.select("load_date", "table", "row_count"), ["load_date", "table"], "left")
    here, rows = F.col("arrived_minute").isNotNull(), F.coalesce("row_count", F.lit(0)).cast("string")
    due = F.col("now_minute") - F.col("expected_at")
    level = F.when(~here, F.when(due >= 60, "error").otherwise("warn")).when(F.col("n_fail") > 0, "error").otherwise("success")
    said = F.when(~here, F.concat("table", F.lit(" has not arrived (expected "), hhmm(F.col("expected_at")), F.lit(")."))) \
        .when(F.col("n_fail") > 0, F.concat("table", F.lit(" arrived ("), rows, F.lit(" rows): "), F.col("n_fail").cast("string"),
                                            F.lit(" check(s) failed."))) \
        .otherwise(F.concat("table", F.lit(" arrived at "), hhmm(F.col("arrived_minute")), F.lit(" ("), rows, F.lit(" rows), "),
                            F.col("n_rules").cast("string"), F.lit(" rules OK.")))
    arrived = a.where(here | (due >= 0)).select(
        F.col("load_date").alias("event_date"), hhmm(F.coalesce("arrived_minute", "now_minute")).alias("event_time"),
        F.lit(0).alias("step"), level.alias("level"), "table", said.alias("message"))
    told = story.where(F.col("kind").isin("detected", "resolved")).select(
        "event_date", "event_time", F.when(F.col("kind") == "detected", 1).otherwise(2).alias("step"),
        F.when(F.col("kind") == "detected", "error").otherwise("success").alias("level"), "table",
        F.concat("incident_id", F.when(F.col("kind") == "detected", F.lit(" opened: ")).otherwise(F.lit(" resolved: ")), "table").alias("message"))
    log = arrived.unionByName(told).orderBy(F.desc("event_date"), F.desc("event_time"), F.desc("step"), "table", "message")
    return log.limit(limit) if limit else log
