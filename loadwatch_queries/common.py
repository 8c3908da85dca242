"""Tables, contracts and SQL fragments the registered queries share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.model import Catalog, Rule, TableSpec
from loadwatch.operators.rules import validate_rule
from loadwatch.sources.connector import align_to_spec, infer_spec, scan_parquet, tag_loads

SNAPSHOT_DAY = date(2024, 1, 30)
SNAPSHOT = "DATE '2024-01-30'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf}/{name}.parquet")


def loads_of(df: DataFrame, name: str, date_column: str = "", **attributes) -> tuple[DataFrame, TableSpec]:
    """A table tagged by load date and its contract; without a date column it is one snapshot."""
    kind = "incremental" if date_column else "snapshot"
    spec = infer_spec(df, name, date_column=date_column, **{"load_type": kind, **attributes})
    return align_to_spec(tag_loads(df, spec, SNAPSHOT_DAY), spec), spec


def rules_of(spec: TableSpec, *rules: tuple) -> list[Rule]:
    """Validated rules from (id, type, severity, params)."""
    catalog = Catalog((spec,))
    return [validate_rule(Rule(i, spec.name, kind, severity, params), catalog) for i, kind, severity, params in rules]


SHOWN = ["load_date", "check_id", "status", "value", "failing_rows", "total_rows"]


def shown(checks: DataFrame) -> DataFrame:
    """The columns of check results the SQL side also gives."""
    return checks.select(*SHOWN)


def row_check_sql(source: str, day: str, rules: list[tuple[str, str, float]]) -> str:
    """SQL of row rules (id, bad condition, tolerance) over `source`, one row per load date and rule."""
    counts = ", ".join(f"count(*) FILTER (WHERE {bad}) AS b{i}" for i, (_, bad, _) in enumerate(rules))
    parts = " UNION ALL ".join(
        f"SELECT load_date, '{rule}' AS check_id, b{i} AS bad, n, CAST({tolerance} AS DOUBLE) AS tol FROM w"
        for i, (rule, _, tolerance) in enumerate(rules))
    return f"""
        WITH w AS (SELECT {day} AS load_date, count(*) AS n, {counts} FROM {source} GROUP BY 1), l AS ({parts})
        SELECT load_date, check_id,
               CASE WHEN bad > 0 AND 100.0::DOUBLE * bad / n > tol THEN 'fail' ELSE 'ok' END AS status,
               round_even(100.0::DOUBLE * bad / n, 3) AS value, bad AS failing_rows, n AS total_rows
        FROM l"""


def band_sql(daily: str, prefix: str = "") -> str:
    """CTEs ending in `{prefix}bands`: the clean walk over `daily` (key, d, v, z, wk, vol) as a recursion by day."""
    p = prefix
    return f"""
    {p}m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d) AS rn FROM ({daily})),
    {p}walk AS (
      SELECT key, 0::BIGINT AS rn, NULL::DATE AS d, NULL::DOUBLE AS v, NULL::DOUBLE AS z, false AS vol, false AS used,
             NULL::DOUBLE AS center, NULL::DOUBLE AS spread, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, true AS ok,
             []::STRUCT(d DATE, v DOUBLE)[] AS base
      FROM (SELECT DISTINCT key FROM {p}m)
      UNION ALL
      SELECT key, rn, d, v, z, vol, used, center, spread, lo, hi, ok,
             CASE WHEN ok THEN list_append(base, {{'d': d, 'v': v}})[-60:] ELSE base END
      FROM (SELECT *, center IS NULL OR CASE WHEN vol THEN v >= lo - 1e-9 * spread AND v <= hi + 1e-9 * spread ELSE abs((v - center) / spread) <= z + 1e-9 END AS ok
      FROM (SELECT *, CASE WHEN center IS NULL THEN NULL WHEN vol AND typical < 30 THEN 0
                           WHEN vol THEN greatest(center - z * spread, 0) ELSE center - z * spread END AS lo,
                      CASE WHEN center IS NULL THEN NULL WHEN vol AND typical < 30 THEN greatest(center + z * spread, 3 * center, 30)
                           ELSE center + z * spread END AS hi
      FROM (SELECT *, CASE WHEN center IS NULL THEN NULL ELSE greatest(
                          sqrt(list_aggregate(list_transform(w, lambda q: power(q - list_aggregate(w, 'favg'), 2)), 'fsum') / (len(w) - 1)),
                          1.4826 * list_median(list_transform(w, lambda q: abs(q - center))), abs(center) * 0.05,
                          CASE WHEN vol THEN greatest(1.0, sqrt(typical)) ELSE 0 END, 1e-9) END AS spread
      FROM (SELECT *, CASE WHEN len(w) < 4 THEN NULL ELSE list_median(w) END AS center
      FROM (SELECT *, CASE WHEN used
                           THEN list_transform(list_filter(base, lambda e: isodow(e.d) = isodow(d)), lambda e: e.v)[-6:]
                           ELSE list_transform(base, lambda e: e.v)[-14:] END AS w
      FROM (SELECT *, wk AND NOT (vol AND typical < 30) AS used
      FROM (SELECT m.key, m.rn, m.d, m.v, m.z, m.wk, m.vol, r.base,
                   coalesce(list_median(list_transform(r.base, lambda e: e.v)), 0) AS typical
            FROM {p}walk r JOIN {p}m m ON m.key = r.key AND m.rn = r.rn + 1))))))) s
    ),
    {p}bands AS (SELECT key, d, v, z, vol, used, center, spread, lo, hi, (v - center) / spread AS score, ok
                 FROM {p}walk WHERE rn > 0)"""


NUDGE = 3e-7  # moves exact halves off the rounding limit, where the last digit of a sum would decide


def rounded(name: str):
    """A computed number to 4 decimals: the order of a floating sum changes its last digits."""
    return (F.round(F.col(name) + F.lit(NUDGE), 4) + F.lit(0.0)).alias(name)


def rounded_sql(expression: str, name: str) -> str:
    return f"round({expression} + {NUDGE}::DOUBLE, 4) + 0::DOUBLE AS {name}"


def rounded_bands(bands: DataFrame) -> DataFrame:
    """Bands with the precision both engines agree on."""
    numbers = [rounded(c) for c in ("value", "center", "spread", "lo", "hi", "score")]
    return bands.select("check_id", "load_date", *numbers, "weekday_used", "passed")


ROUNDED_BANDS = ("SELECT key AS check_id, d AS load_date, "
                 + ", ".join(rounded_sql(c, n) for c, n in (("v", "value"), ("center", "center"), ("spread", "spread"),
                                                            ("lo", "lo"), ("hi", "hi"), ("score", "score")))
                 + ", used AS weekday_used, ok AS passed")
