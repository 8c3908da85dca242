"""Column profiles, suggested rules and segment indicators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwatch.model import NUMERIC, TEXT, Field, TableSpec
from loadwatch.operators.rules import is_identifier, quoted

MAX_CATALOGUE, MIN_PRESENT = 12, 30  # fixed values: when a text column looks like a short catalogue


def _text(field: Field) -> str:
    c = f"`{field.name}`"
    return f"CAST({c} + 0.0D AS STRING)" if field.data_type() in ("double", "float") else f"CAST({c} AS STRING)"


def _identity(field: Field) -> str:
    """What tells one value from another: the value, or the SHA-256 of a text, whatever its length."""
    return f"sha2({_text(field)}, 256)" if field.type == TEXT else _text(field)


def profile(df: DataFrame, spec: TableSpec, exact: bool = True) -> DataFrame:
    """Per load date and column: null percentage, distinct values and, for numbers, minimum, maximum and mean.

    Everything but the distinct count is one aggregation by load date over the columns as they are. The exact count turns
    cells into narrow (column, value) pairs, distinct in every task before the only shuffle that carries data, so a hot value
    costs one row per task. `exact=False` estimates the distinct count within the first aggregation.
    """
    return _exact_profile(df, spec) if exact else _estimated_profile(df, spec)


def _finish(rows: DataFrame, spec: TableSpec) -> DataFrame:
    names, types = (", ".join(map(quoted, v)) for v in (spec.column_names, [c.type for c in spec.columns]))
    return rows.selectExpr(
        "load_date", f"{quoted(spec.name)} AS `table`", "position", f"get(array({names}), position) AS column",
        f"get(array({types}), position) AS type", "CASE WHEN n > 0 THEN bround(100 * nulls / n, 2) END AS null_pct",
        "CAST(distinct_values AS BIGINT) AS distinct_values", "min_value", "max_value", "bround(mean_value, 2) AS mean_value")


def _exact_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    cells = ", ".join(f"struct({i} AS position, {_identity(c)} AS shown)" for i, c in enumerate(spec.columns))
    values = df.selectExpr("load_date", f"inline(array({cells}))").where("shown IS NOT NULL").distinct()
    counts = values.groupBy("load_date", "position").agg(F.expr("count(1) AS distinct_values"))
    rows = _basics(df, spec, estimate=False).drop("distinct_values").join(counts, ["load_date", "position"], "left") \
        .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return _finish(rows, spec)


def _estimated_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _finish(_basics(df, spec, estimate=True), spec)


def _basics(df: DataFrame, spec: TableSpec, estimate: bool) -> DataFrame:
    """One aggregation by load date, turned into one row per column."""
    aggregates, cells = ["count(1) AS n"], []
    for i, c in enumerate(spec.columns):
        name = f"`{c.name}`"
        about = f"approx_count_distinct({_text(c)})" if estimate else "CAST(0 AS BIGINT)"
        aggregates += [f"count_if({name} IS NULL) AS nulls_{i}", f"{about} AS distinct_{i}"]
        numbers = {"min": "CAST(NULL AS DOUBLE)", "max": "CAST(NULL AS DOUBLE)", "mean": "CAST(NULL AS DOUBLE)"}
        if c.type in NUMERIC:
            aggregates += [f"CAST(min({name}) AS DOUBLE) AS min_{i}", f"CAST(max({name}) AS DOUBLE) AS max_{i}",
                           f"CAST(avg({name}) AS DOUBLE) AS mean_{i}"]
            numbers = {k: f"{k}_{i}" for k in numbers}
        cells.append(f"struct({i} AS position, nulls_{i} AS nulls, distinct_{i} AS distinct_values, "
                     + ", ".join(f"{v} AS {k}_value" for k, v in numbers.items()) + ")")
    by_day = df.groupBy("load_date").agg(*[F.expr(a) for a in aggregates])
    return by_day.selectExpr("load_date", "n", f"inline(array({', '.join(cells)}))")


# -------------------------------------------------------------- suggestions
def suggest_rules(load: DataFrame, spec: TableSpec) -> list[dict[str, Any]]:
    """First rules for a table that has none, from the profile of one load; an empty load suggests nothing.

    Two aggregations at most, one row each. The estimate of the first one never exceeds the true number of
    distinct values while that number is this small (it counts touched registers), so no short catalogue is missed.
    """
    ids = [c for c in spec.columns if is_identifier(c.name)]
    numbers = [c for c in spec.columns if c.type in NUMERIC and not is_identifier(c.name)]
    texts = [c for c in spec.columns if c.type == TEXT and not is_identifier(c.name)]

    def present(c: Field) -> str:
        return f"(`{c.name}` IS NOT NULL AND CAST(`{c.name}` AS STRING) <> '')"

    first = ["count(1) AS n"]
    first += [f"count_if({present(c)}) AS `present:{c.name}`" for c in spec.columns]
    first += [f"CAST(min(`{c.name}`) AS DOUBLE) AS `min:{c.name}`" for c in numbers]
    first += [f"approx_count_distinct(CASE WHEN {present(c)} THEN {_text(c)} END) AS `about:{c.name}`" for c in texts]
    seen = load.agg(*map(F.expr, first)).first()
    n = seen["n"]
    if n == 0:
        return []
    short = [c for c in texts if seen[f"present:{c.name}"] >= MIN_PRESENT and seen[f"about:{c.name}"] <= MAX_CATALOGUE]
    full_ids = [c for c in ids if seen[f"present:{c.name}"] == n]
    unique = [c for c in full_ids if spec.load_type == "incremental"]
    second = [f"array_sort(collect_set(CASE WHEN {present(c)} THEN {_text(c)} END)) AS `values:{c.name}`" for c in short]
    found = load.agg(*map(F.expr, second)).first() if second else {}
    distinct = {c.name: load.groupBy(F.col(f"`{c.name}`")).agg(F.count(F.lit(1)).alias("times"))
                .agg(F.max("times")).first()[0] == 1 for c in unique}
    out = []
    for c in spec.columns:
        if c in full_ids:
            out.append({"table": spec.name, "type": "not_null", "severity": "high", "params": {"column": c.name},
                        "note": f"from the first load: {n} of {n} cells filled"})
            if distinct.get(c.name):
                out.append({"table": spec.name, "type": "unique", "severity": "critical", "params": {"columns": [c.name]},
                            "note": f"from the first load: {n} distinct values in {n} rows"})
        if c in numbers and seen[f"present:{c.name}"] and seen[f"min:{c.name}"] >= 0:
            out.append({"table": spec.name, "type": "range", "severity": "medium", "params": {"column": c.name, "min": 0},
                        "note": f"from the first load: smallest value {seen[f'min:{c.name}']:g}"})
        if c in short and 2 <= len(found[f"values:{c.name}"]) <= MAX_CATALOGUE:
            out.append({"table": spec.name, "type": "allowed_values", "severity": "medium",
                        "params": {"column": c.name, "values": list(found[f"values:{c.name}"])},
                        "note": f"from the first load: {len(found[f'values:{c.name}'])} values seen"})
    return out


# ----------------------------------------------------------------- segments
def segment_indicators(facts: DataFrame, segments: DataFrame, segment: str, amount: str, days_late: str) -> DataFrame:
    """Per segment: records, total, overdue total (more than 30 days) and its share; empty segments stay with zeros.

    Facts are added up before the join, so a segment that holds most of the rows costs one row per task.
    """
    sums = facts.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(amount).alias("total"),
        F.sum(F.when(F.col(days_late) > 30, F.col(amount))).alias("overdue"))
    total, overdue = F.coalesce("total", F.lit(0.0)), F.coalesce("overdue", F.lit(0.0))
    return segments.select(segment).distinct().join(sums, segment, "left").select(
        segment, F.coalesce("n_records", F.lit(0)).cast("bigint").alias("n_records"),
        F.round(total, 0).alias("total"), F.round(overdue, 0).alias("overdue"),
        F.when(total != 0, F.round(100 * overdue / total, 2)).otherwise(0.0).alias("overdue_pct"))
