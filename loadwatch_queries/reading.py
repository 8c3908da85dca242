"""What people read: series, bands, heatmaps, summaries, indicators, exports and the log."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from loadwatch.operators import incidents as inc
from loadwatch.operators.baseline import base_points, expected_rows
from loadwatch.plans import report
from loadwatch.session import stage
from loadwatch_queries.common import rounded, rounded_sql
from loadwatch_queries.state import LAST_MINUTE, _hhmm, state, with_state

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


@query(with_state("""SELECT load_date, score, score < 80 AS low FROM (
    SELECT load_date, round(avg(score), 1) AS score FROM scores GROUP BY 1 ORDER BY load_date DESC LIMIT 60)"""))
def global_score_series(spark, sf):
    return report.score_series(state(spark, sf).validation.metrics)


@query(with_state("SELECT load_date, score, score < 80 AS low FROM scores WHERE tbl = 'view' ORDER BY load_date DESC LIMIT 60"))
def table_score_series(spark, sf):
    return report.score_series(state(spark, sf).validation.metrics, "view")


@query(with_state("""SELECT tbl AS "table", string_agg(CAST(score AS VARCHAR), ' ' ORDER BY load_date) AS sparkline FROM (
    SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY load_date DESC) AS age FROM scores) WHERE age <= 30 GROUP BY 1"""))
def score_sparklines(spark, sf):
    return report.sparklines(state(spark, sf).validation.metrics)


def _band_sql(kind: str) -> str:
    return with_state(f"""SELECT d AS load_date, {rounded_sql('v', 'value')}, {rounded_sql('lo', 'lo')}, {rounded_sql('hi', 'hi')},
        lo IS NOT NULL AND (v < lo OR v > hi) AS anomalous FROM {kind} WHERE tbl = 'click' ORDER BY d DESC LIMIT 60""")


@query(_band_sql("vb"))
def volume_band(spark, sf):
    points = report.metric_bands(state(spark, sf).validation.metrics, "click", "rows")
    return points.select("load_date", rounded("value"), rounded("lo"), rounded("hi"), "anomalous")


@query(_band_sql("ob"))
def outlier_band(spark, sf):
    points = report.metric_bands(state(spark, sf).validation.metrics, "click", "rule:R005")
    return points.select("load_date", rounded("value"), rounded("lo"), rounded("hi"), "anomalous")


@query(with_state("""SELECT check_id, name, load_date, status FROM checks WHERE tbl = 'error' AND load_date IN (
    SELECT DISTINCT load_date FROM checks WHERE tbl = 'error' ORDER BY load_date DESC LIMIT 30)"""))
def check_heatmap(spark, sf):
    return report.heatmap(state(spark, sf).checks, "error")


_GRID = [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]


@query(with_state("SELECT check_id, name, " + ", ".join(f"max(status) FILTER (WHERE load_date = DATE '{d}') AS \"{d}\"" for d in _GRID)
                  + " FROM checks WHERE tbl = 'signup' GROUP BY 1, 2"))
def check_grid(spark, sf):
    """The heatmap as a grid, one column per day of the tables."""
    return report.heatmap_grid(state(spark, sf).checks, "signup", _GRID)


def _summary(s):
    history = stage(base_points(s.validation.metrics), "history")
    expected = expected_rows(history, s.arrivals.join(s.specs.select("table", "load_type"), "table"))
    return report.table_summary(s.specs, s.arrivals, s.checks, s.validation.scores, s.validation.metrics, expected, s.loads)


_SUMMARY = f"""counted AS (SELECT load_date, tbl, count(*) AS checks_total, count(*) FILTER (WHERE status = 'ok') AS checks_ok,
        count(*) FILTER (WHERE kind = 'rule') AS rules_total, count(*) FILTER (WHERE status = 'fail') AS n_fail,
        count(*) FILTER (WHERE status = 'warn') AS n_warn,
        string_agg(name, '; ' ORDER BY check_order) FILTER (WHERE status = 'fail') AS failing FROM checks GROUP BY 1, 2),
    expect AS (SELECT t.tbl, t.d, list(h.v ORDER BY h.d)[-60:][-14:] AS s FROM vb t JOIN (SELECT * FROM vb WHERE ok) h ON h.tbl = t.tbl AND h.d < t.d GROUP BY 1, 2),
    sparks AS (SELECT tbl, string_agg(CAST(score AS VARCHAR), ' ' ORDER BY load_date) AS sparkline FROM (
        SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY load_date DESC) AS age FROM scores) WHERE age <= 30 GROUP BY 1),
    summary AS (SELECT a.d AS load_date, a.tbl, 'Events: ' || a.tbl AS title, a.tbl || ' team' AS owner, '00:00' AS expected_at,
        CASE WHEN arrived IS NULL THEN 'missing' WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' ELSE 'ok' END AS status,
        CASE WHEN arrived IS NOT NULL THEN {_hhmm('arrived')} END AS arrived_at, n AS row_count,
        CASE WHEN len(s) >= 4 THEN CAST(round_even(list_median(s), 0) AS BIGINT) END AS expected_rows, score, checks_total, checks_ok, rules_total,
        coalesce(failing, '') AS failing, sparkline
      FROM a LEFT JOIN counted c ON c.tbl = a.tbl AND c.load_date = a.d LEFT JOIN expect x ON x.tbl = a.tbl AND x.d = a.d
      LEFT JOIN scores o ON o.tbl = a.tbl AND o.load_date = a.d LEFT JOIN sparks p ON p.tbl = a.tbl)"""


@query(with_state(f""", {_SUMMARY} SELECT load_date, tbl AS "table", title, owner, expected_at, status, arrived_at, row_count, expected_rows, score,
    checks_total, checks_ok, rules_total, failing, sparkline FROM summary"""))
def table_summaries(spark, sf):
    return _summary(state(spark, sf))


_KPIS = f"""today AS (SELECT * FROM summary WHERE load_date = (SELECT max(d) FROM a)),
    kpis AS (SELECT max(load_date) AS load_date, round_even(avg(score), 1) AS score, count(*) AS tables_total, count(arrived_at) AS tables_arrived,
        count(*) FILTER (WHERE status = 'ok') AS tables_ok, count(*) FILTER (WHERE status = 'missing') AS tables_missing,
        (SELECT count(*) FROM incidents WHERE resolved_date IS NULL) AS open_incidents, CAST(sum(checks_total) AS BIGINT) AS checks_today,
        (SELECT count(*) FROM checks WHERE status = 'fail' AND load_date = (SELECT max(d) FROM a)) AS checks_failed,
        CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows_today,
        (SELECT round_even(avg(minutes_open) FILTER (WHERE resolved_date IS NOT NULL) / 60, 1) FROM incidents) AS mttr_hours FROM today)"""


def _kpis(s, summary):
    newest = s.arrivals.agg(F.max("load_date")).first()[0]
    found = inc.incidents(s.validation.observations, None, s.specs)
    return newest, report.kpi_snapshot(summary, s.checks, found, newest, LAST_MINUTE)


@query(with_state(f", {_SUMMARY}, {_KPIS} SELECT * FROM kpis"))
def daily_indicators(spark, sf):
    s = state(spark, sf)
    return _kpis(s, _summary(s))[1]


_NUMBER = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"


@query(with_state(f""", {_SUMMARY}, {_KPIS}, gauges AS (
    SELECT 0 AS position, 'quality_score' AS metric, '' AS label, CAST(score AS DOUBLE) AS value FROM kpis
    UNION ALL SELECT 1, 'open_incidents', '', open_incidents FROM kpis UNION ALL SELECT 2, 'tables_missing', '', tables_missing FROM kpis
    UNION ALL SELECT 3, 'checks_failed', '', checks_failed FROM kpis UNION ALL SELECT 4, 'table_score', tbl, score FROM today
    UNION ALL SELECT 5, 'table_rows', tbl, row_count FROM today)
    SELECT position, 'loadwatch_' || metric AS metric, label, value,
      'loadwatch_' || metric || CASE WHEN label = '' THEN '' ELSE '{{table="' || label || '"}}' END || ' ' || {_NUMBER} AS line FROM gauges WHERE value IS NOT NULL"""))
def exported_metrics(spark, sf):
    s = state(spark, sf)
    summary = _summary(s)
    newest, kpis = _kpis(s, summary)
    return report.metrics_export(kpis, summary.where(F.col("load_date") == F.lit(newest)))


@query(with_state(f""", log AS (
    SELECT a.d AS event_date, {_hhmm('coalesce(arrived, now_minute)')} AS event_time, 0 AS step, CASE WHEN arrived IS NULL OR n_fail > 0 THEN 'error' ELSE 'success' END AS level, a.tbl AS "table",
      CASE WHEN arrived IS NULL THEN a.tbl || ' has not arrived (expected 00:00).'
           WHEN n_fail > 0 THEN a.tbl || ' arrived (' || n || ' rows): ' || n_fail || ' check(s) failed.'
           ELSE a.tbl || ' arrived at ' || {_hhmm('arrived')} || ' (' || n || ' rows), ' || n_rules || ' rules OK.' END AS message
    FROM a JOIN (SELECT load_date, tbl, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE kind = 'rule') AS n_rules FROM checks GROUP BY 1, 2) c
      ON c.tbl = a.tbl AND c.load_date = a.d
    UNION ALL SELECT opened_date, {_hhmm('opened_minute')}, 1, 'error', tbl, incident_id || ' opened: ' || tbl FROM incidents
    UNION ALL SELECT resolved_date, {_hhmm('resolved_minute')}, 2, 'success', tbl, incident_id || ' resolved: ' || tbl FROM incidents WHERE resolved_date IS NOT NULL)
    SELECT event_date, event_time, step, level, "table", message FROM log ORDER BY event_date DESC, event_time DESC, step DESC, "table", message LIMIT 150"""))
def event_log(spark, sf):
    s = state(spark, sf)
    story = inc.timeline(s.validation.observations, s.specs)
    return report.validation_log(s.arrivals, s.specs, s.checks, s.loads, story, limit=150)
