"""Clean histories, bands, outliers and volume."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from loadwatch.model import Catalog, specs_frame
from loadwatch.operators.baseline import (base_points, clean_history, expected_rows, metrics_of, outlier_results,
                                          outlier_series, replay, score_new_loads, volume_results, volume_series)
from loadwatch.operators.evaluate import daily_stats, rule_facts
from loadwatch.plans.report import metric_bands
from loadwatch.session import stage
from loadwatch_queries.common import ROUNDED_BANDS, band_sql, loads_of, rounded, rounded_bands, rounded_sql, rules_of, table
from loadwatch_queries.state import _loc

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


def _daily(source: str, day: str, series: list[tuple[str, str, float, bool, bool]]) -> str:
    """SQL of daily series (key, aggregate, z, weekday, volume) over `source`."""
    return " UNION ALL ".join(
        f"SELECT '{key}' AS key, {day} AS d, CAST({value} AS DOUBLE) AS v, CAST({z} AS DOUBLE) AS z, {wk} AS wk, {vol} AS vol "
        f"FROM {source} GROUP BY 2" for key, value, z, wk, vol in series)


def _outlier_bands(df, spec, rules):
    facts = rule_facts(df.sparkSession, Catalog((spec,), tuple(rules)))
    return replay(outlier_series(daily_stats(df, spec, rules), facts))


def _volume_bands(df, spec):
    return replay(volume_series(daily_stats(df, spec, []), specs_frame(df.sparkSession, Catalog((spec,)))))


# --------------------------------------------------------------- outliers
_ORDER_SERIES = _daily("orders", "CAST(o_orderdate AS DATE)", [
    ("W1", "sum(o_totalprice)", 2, True, False), ("W2", "avg(o_totalprice)", 2, True, False), ("W3", "max(o_totalprice)", 3, True, False)])


@query(f"WITH RECURSIVE {band_sql(_ORDER_SERIES)} {ROUNDED_BANDS} FROM bands")
def outlier_same_weekday(spark, sf):
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, *[(i, "outlier", "high", {"column": "o_totalprice", "aggregate": a, "z": z})
                             for i, a, z in (("W1", "sum", 2), ("W2", "avg", 2), ("W3", "max", 3))])
    return rounded_bands(_outlier_bands(df, spec, rules))


_EVENT_SERIES = _daily("events", "CAST(ts AS DATE)", [
    ("T1", "sum(value)", 1.2, False, False), ("T2", "avg(value)", 1.5, False, False), ("T3", "min(value)", 2, False, False),
    ("T4", "count(*)", 1, False, False)])


def _event_rules(spec):
    return rules_of(spec, *[(i, "outlier", "medium", {"column": "value", "aggregate": a, "z": z, "same_weekday": False})
                            for i, a, z in (("T1", "sum", 1.2), ("T2", "avg", 1.5), ("T3", "min", 2), ("T4", "count", 1))])


@query(f"WITH RECURSIVE {band_sql(_EVENT_SERIES)} {ROUNDED_BANDS} FROM bands")
def outlier_trailing(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    return rounded_bands(_outlier_bands(df, spec, _event_rules(spec)))


@query(f"""WITH RECURSIVE {band_sql(_EVENT_SERIES)}
    SELECT d AS load_date, key AS check_id, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status, round_even(v, 4) AS value,
           CASE WHEN center IS NULL THEN 'no band yet' ELSE {_loc('lo')} || ' to ' || {_loc('hi')} END AS threshold,
           concat_ws('; ', 'value: ' || {_loc('v')}, CASE WHEN center IS NOT NULL THEN 'band: ' || {_loc('lo')} || ' to ' || {_loc('hi')} END,
             CASE WHEN center IS NOT NULL THEN 'usual: ' || {_loc('center')} END, CASE WHEN NOT ok THEN 'spreads away: ' || format('{{:+.1f}}', round_even(score, 1)) END,
             'of: ' || said || ' value') AS message
    FROM (SELECT *, CASE key WHEN 'T1' THEN 'sum' WHEN 'T2' THEN 'avg' WHEN 'T3' THEN 'min' ELSE 'count' END AS said FROM bands)""")
def outlier_checks(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    rules = _event_rules(spec)
    facts = rule_facts(spark, Catalog((spec,), tuple(rules)))
    checks = outlier_results(_outlier_bands(df, spec, rules), facts)
    return checks.select("load_date", "check_id", "status", "value", "threshold", "message")


# ----------------------------------------------------------------- volume
@query(f"""WITH RECURSIVE {band_sql(_daily('orders', 'CAST(o_orderdate AS DATE)', [('rows', 'count(*)', 3.5, True, True)]))}
    {ROUNDED_BANDS} FROM bands""")
def volume_sparse(spark, sf):
    return rounded_bands(_volume_bands(*loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")))


@query(f"""WITH RECURSIVE {band_sql(_daily('events', 'CAST(ts AS DATE)', [('rows', 'count(*)', 3.5, False, True)]))}
    {ROUNDED_BANDS} FROM bands""")
def volume_trailing(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    return rounded_bands(_volume_bands(df, replace(spec, load_type="snapshot")))


_LEDGER = """(SELECT CAST(o.o_orderdate AS DATE) AS day FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
              UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag <> 'N')"""


def _ledger(spark, sf):
    """Entries of a ledger: one when a line is ordered, one when it ships and one when it is billed again."""
    line = table(spark, sf, "lineitem")
    ordered = table(spark, sf, "orders").join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").cast("date").alias("day"))
    shipped = line.select(F.col("l_shipdate").cast("date").alias("day"))
    return ordered.unionByName(shipped).unionByName(line.where("l_returnflag <> 'N'").select(F.col("l_shipdate").cast("date").alias("day")))


@query(f"""WITH RECURSIVE {band_sql(_daily(_LEDGER, 'day', [('rows', 'count(*)', 3.5, True, True)]))} {ROUNDED_BANDS} FROM bands""")
def volume_same_weekday(spark, sf):
    return rounded_bands(_volume_bands(*loads_of(_ledger(spark, sf), "ledger", "day")))


@query(f"""WITH RECURSIVE {band_sql(_daily(_LEDGER, 'day', [('rows', 'count(*)', 3.5, True, True)]))}
    SELECT d AS load_date, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS status, v AS value, CAST(v AS BIGINT) AS total_rows,
      CASE WHEN center IS NULL THEN 'no band yet' ELSE replace(format('{{:,.0f}}', lo), ',', '.') || ' to '
           || replace(format('{{:,.0f}}', hi), ',', '.') END AS threshold FROM bands""")
def volume_checks(spark, sf):
    checks = volume_results(_volume_bands(*loads_of(_ledger(spark, sf), "ledger", "day")))
    return checks.select("load_date", "status", "value", "total_rows", "threshold")


# -------------------------------------------------------- stored histories
def _event_metrics(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    return stage(metrics_of(_outlier_bands(df, spec, _event_rules(spec))), "metrics")


@query(f"""WITH RECURSIVE {band_sql(_EVENT_SERIES)}
    SELECT d AS load_date, 'events' AS "table", 'rule:' || key || suffix AS metric, {rounded_sql('value', 'value')} FROM (
      SELECT key, d, '' AS suffix, v AS value FROM bands UNION ALL SELECT key, d, ':lo', lo FROM bands UNION ALL
      SELECT key, d, ':hi', hi FROM bands UNION ALL SELECT key, d, ':base', v FROM bands WHERE ok) WHERE value IS NOT NULL""")
def band_metrics(spark, sf):
    return _event_metrics(spark, sf).withColumn("value", rounded("value"))


@query(f"""WITH RECURSIVE {band_sql(_ORDER_SERIES)}
    SELECT 'orders' AS "table", 'rule:' || key || ':base' AS metric, d AS load_date, {rounded_sql('v', 'value')}, CAST(age AS INTEGER) AS age FROM (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY d DESC) AS age FROM bands WHERE ok AND d < (SELECT max(CAST(o_orderdate AS DATE)) FROM orders))
    WHERE age <= 60""")
def last_clean_points(spark, sf):
    """The 60 clean points before the newest day."""
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, *[(i, "outlier", "high", {"column": "o_totalprice", "aggregate": a, "z": z})
                             for i, a, z in (("W1", "sum", 2), ("W2", "avg", 2), ("W3", "max", 3))])
    newest = df.agg(F.max("load_date")).scalar()
    return clean_history(metrics_of(_outlier_bands(df, spec, rules)), newest).withColumn("value", rounded("value"))


@query(f"WITH RECURSIVE {band_sql(_EVENT_SERIES)} {ROUNDED_BANDS} FROM bands WHERE d = (SELECT max(d) FROM bands)")
def one_new_day(spark, sf):
    """The newest day judged against the stored history of the days before, without Python workers."""
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    rules = _event_rules(spec)
    series = stage(outlier_series(daily_stats(df, spec, rules), rule_facts(spark, Catalog((spec,), tuple(rules)))), "series")
    newest = series.agg(F.max("load_date")).scalar()
    history = base_points(metrics_of(replay(series.where(F.col("load_date") < newest))))
    return rounded_bands(score_new_loads(history, series.where(F.col("load_date") == newest)))


@query(f"""WITH RECURSIVE {band_sql(_daily(_LEDGER, 'day', [('rows', 'count(*)', 3.5, True, True)]))},
    p AS (SELECT t.d, list(h.v ORDER BY h.d) AS base, list(h.d ORDER BY h.d) AS days FROM bands t
          JOIN (SELECT * FROM bands WHERE ok) h ON h.d < t.d GROUP BY t.d),
    w AS (SELECT d, list_filter(list_transform(range(1, len(base[-60:]) + 1), lambda i: CASE WHEN isodow(days[-60:][i]) = isodow(d) THEN base[-60:][i] END),
                 lambda x: x IS NOT NULL)[-6:] AS s FROM p)
    SELECT 'ledger' AS "table", b.d AS load_date, CASE WHEN len(s) >= 4 THEN CAST(round_even(list_median(s), 0) AS BIGINT) END AS expected_rows
    FROM bands b LEFT JOIN w USING (d)""")
def expected_row_counts(spark, sf):
    df, spec = loads_of(_ledger(spark, sf), "ledger", "day")
    bands = stage(_volume_bands(df, spec), "bands")
    history = bands.where("passed").select("table", "check_id", "load_date", "value")
    days = bands.select("table", "load_date", F.lit("incremental").alias("load_type"))
    return expected_rows(history, days)


@query(f"""WITH RECURSIVE {band_sql(_EVENT_SERIES)}
    SELECT d AS load_date, {rounded_sql('v', 'value')}, {rounded_sql('lo', 'lo')}, {rounded_sql('hi', 'hi')}, lo IS NOT NULL AND (v < lo OR v > hi) AS anomalous
    FROM bands WHERE key = 'T1' ORDER BY d DESC LIMIT 60""")
def band_chart(spark, sf):
    """Value, band and anomaly flag of a metric by day."""
    points = metric_bands(_event_metrics(spark, sf), "events", "rule:T1")
    return points.select("load_date", *[rounded(c) for c in ("value", "lo", "hi")], "anomalous")
