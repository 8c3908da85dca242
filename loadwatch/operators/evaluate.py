"""Evaluation of the rules of a table over all its load dates.

Every row rule and every daily aggregate of a table share one scan and one aggregation by load date; for a load of one day they can
instead be observed by the job that stores its rows (`Observed`), and no scan is left for them. All uniqueness rules of a table share one more
scan and one shuffle, of digests of their keys. A custom condition may look into other tables by name (`visible`).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date
from functools import reduce
from typing import Any

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwatch.functions.scalars import evidence_number, half_even, thousands
from loadwatch.model import ERROR, FAIL, NUMERIC, OK, TEXT, Catalog, Rule, TableSpec, small_frame
from loadwatch.operators.rules import (ROW_RULES, analysis_error, bad_rows, daily_value, describe, is_identifier, quoted,
                                       rule_sql)
from loadwatch.session import stage

TIE_CHARACTERS = 64
MONITOR_CHECKS = 3  # availability, volume and structure come before the rules
STAT_COLUMNS = ("table", "load_date", "check_id", "kind", "value", "failing_rows", "repeated_groups", "total_rows")


# --------------------------------------------------------------- statistics
def daily_stats(df: DataFrame, spec: TableSpec, rules: list[Rule], days: DataFrame | None = None) -> DataFrame:
    """Long daily statistics: one row per (load date, check), `check_id` = `rows` for the row count.

    kind is `rows`, `row` (a row rule), `outlier` (a daily aggregate) or `unique`. `days` lists the
    delivered load dates when some of them may have brought no row at all.
    """
    fused = _fused_stats(df, spec, [r for r in rules if r.type in ROW_RULES or r.type == "outlier"])
    unique = [r for r in rules if r.type == "unique"]
    parts = [fused] + ([_unique_stats(df, spec, unique)] if unique else [])
    stats = _of_table(reduce(DataFrame.unionAll, parts), spec)
    if days is None:
        return stats
    return fill_days(stats, days.select("load_date", F.lit(spec.name).alias("table")), {spec.name: rules})


def _of_table(stats: DataFrame, spec: TableSpec) -> DataFrame:
    return stats.selectExpr(f"{quoted(spec.name)} AS `table`", *STAT_COLUMNS[1:])


def further_stats(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> list[DataFrame]:
    """Statistics of uniqueness rules and custom conditions alone, where the others are known from the write; nothing is read without such rules."""
    unique, custom = [r for r in rules if r.type == "unique"], [r for r in rules if r.type == "sql"]
    parts = [_unique_stats(df, spec, unique)] if unique else []
    parts += [_fused_stats(df, spec, custom).where("kind = 'row'")] if custom else []
    return [_of_table(p, spec) for p in parts]


def fill_days(stats: DataFrame, delivered: DataFrame, rules: dict[str, list[Rule]]) -> DataFrame:
    """Statistics completed with zeros for delivered (load_date, table) pairs that brought no row."""
    kinds = [(t, i, k) for t, own in rules.items()
             for i, k in [("rows", "rows")] + [(r.id, "row" if r.type in ROW_RULES else r.type) for r in own]]
    checks = small_frame(stats.sparkSession, kinds, "table string, check_id string, kind string")
    grid = delivered.select("load_date", "table").distinct().join(checks, "table")
    zero = F.lit(0).cast("bigint")
    measured = F.col("kind").isin("outlier", "rows")
    return grid.join(stats, ["table", "load_date", "check_id", "kind"], "left").select(
        "table", "load_date", "check_id", "kind",
        F.when(measured, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")).alias("value"),
        *[F.coalesce(c, zero).alias(c) for c in ("failing_rows", "repeated_groups", "total_rows")])


def _stat(check_id: str, kind: str, value: str, failing: str) -> str:
    return (f"struct({quoted(check_id)} AS check_id, '{kind}' AS kind, CAST({value} AS DOUBLE) AS value, "
            f"CAST({failing} AS BIGINT) AS failing_rows, 0L AS repeated_groups, row_count AS total_rows)")


def _measures(spec: TableSpec, rules: list[Rule]) -> tuple[dict[str, Column], list[Column], list[str]]:
    """Flags per row, aggregates of one load, and the long statistics made of those."""
    row_rules = [r for r in rules if r.type in ROW_RULES]
    outliers = [r for r in rules if r.type == "outlier"]
    flags = {f"__bad_{i}": bad_rows(r, spec) for i, r in enumerate(row_rules)}
    aggregates = [F.expr("count(1) AS row_count"), *[F.expr(f"count_if({name}) AS n{name}") for name in flags]]
    aggregates += [daily_value(r).alias(f"value_{i}") for i, r in enumerate(outliers)]
    stats = [_stat("rows", "rows", "row_count", "0")]
    stats += [_stat(r.id, "row", "NULL", f"n__bad_{i}") for i, r in enumerate(row_rules)]
    stats += [_stat(r.id, "outlier", f"value_{i}", "0") for i, r in enumerate(outliers)]
    return flags, aggregates, stats


def _fused_stats(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> DataFrame:
    flags, aggregates, stats = _measures(spec, rules)
    # One row per load date after map-side combining, whatever the size of a load.
    wide = (df.withColumns(flags) if flags else df).groupBy("load_date").agg(*aggregates)
    return wide.selectExpr("load_date", f"inline(array({', '.join(stats)}))")


class Observed:
    """Row rules and daily aggregates of one load, measured by the job that writes its rows.

    Custom conditions stay out: one that fails on its data would take the write with it. A task that is run again counts once, with its
    successful attempt, because nothing is shuffled between the measure and the write.
    """

    def __init__(self, df: DataFrame, spec: TableSpec, rules: list[Rule]) -> None:
        self.spec = spec
        self.rules = [r for r in rules if r.type != "unique" and r.type != "sql"]
        self._observation = Observation()
        flags, aggregates, self._stats = _measures(spec, self.rules)
        self.rows = (df.withColumns(flags) if flags else df).observe(self._observation, *aggregates)
        kinds = df.withColumns(flags).agg(*aggregates).schema if flags else df.agg(*aggregates).schema
        self._schema = "load_date date, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)

    def stats(self, spark: SparkSession, day: date) -> DataFrame:
        """The statistics, once `rows` has been written."""
        seen = self._observation.get
        names = [c.split(" ")[0] for c in self._schema.split(", ")][1:]
        wide = small_frame(spark, [(day, *[seen[n] for n in names])], self._schema)
        return _of_table(wide.selectExpr("load_date", f"inline(array({', '.join(self._stats)}))"), self.spec)


def _long_key(spec: TableSpec, columns: list[str]) -> bool:
    """Free text may be long; identifiers are not."""
    return any(spec.column(c).type == TEXT and not is_identifier(c) for c in columns)


def _key_digest(columns: list[str]) -> Column:
    """256 bits that stand for a long key: its parts as JSON, where NULL is no text and lengths can't run together."""
    return F.unhex(F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])), 256))


def key_groups(df: DataFrame, columns: list[str], long_key: bool) -> DataFrame:
    """Rows per key within each load, as `__times`; NULL keys group together.

    One scan and one aggregation with map-side combining. A long key travels as its SHA-256 (`__key`), never as text.
    """
    keys = [_key_digest(columns).alias("__key")] if long_key else [F.col(f"`{c}`") for c in columns]
    return df.groupBy("load_date", *keys).agg(F.expr("count(1) AS __times"))


def duplicate_groups(df: DataFrame, columns: list[str], long_key: bool = False) -> DataFrame:
    """Groups that repeat within a load, with how many `times`."""
    groups = key_groups(df, columns, long_key).where("__times > 1")
    return (_with_texts(df, columns, groups) if long_key else groups).withColumnRenamed("__times", "times")


def _with_texts(df: DataFrame, columns: list[str], groups: DataFrame) -> DataFrame:
    """Groups of digests with the columns of their keys, read back for these groups only."""
    names = [F.col(f"`{c}`") for c in columns]
    shown = df.select("load_date", _key_digest(columns).alias("__key"), *names).join(groups.select("load_date", "__key"), ["load_date", "__key"], "left_semi")
    one = shown.groupBy("load_date", "__key").agg(*[F.min(f"`{c}`").alias(c) for c in columns])  # all rows of a digest are alike
    return one.join(groups, ["load_date", "__key"]).drop("__key")


def _unique_stats(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> DataFrame:
    """All uniqueness rules in one scan and one shuffle: each row gives one (rule, key digest) per rule, copies combined before the shuffle.
    A single rule on short keys needs no digests."""
    if len(rules) == 1:
        columns = rules[0].params["columns"]
        groups = key_groups(df, columns, _long_key(spec, columns)).withColumn("__rule", F.lit(0))
    else:
        tagged = F.inline(F.array(*[F.struct(F.lit(i).alias("__rule"), _key_digest(r.params["columns"]).alias("__key")) for i, r in enumerate(rules)]))
        groups = df.select("load_date", tagged).groupBy("load_date", "__rule", "__key").agg(F.expr("count(1) AS __times"))
    stats = groups.groupBy("load_date", "__rule").agg(
        F.expr("sum(__times - 1) AS failing_rows"), F.expr("count_if(__times > 1) AS repeated_groups"), F.expr("sum(__times) AS total_rows"))
    ids = ", ".join(quoted(r.id) for r in rules)
    return stats.selectExpr("load_date", f"get(array({ids}), __rule) AS check_id", "'unique' AS kind", "CAST(NULL AS DOUBLE) AS value",
                            "failing_rows", "repeated_groups", "total_rows")


# ------------------------------------------------- conditions over other tables
_SUBQUERY = re.compile(r"\bselect\b", re.IGNORECASE)


def looks_elsewhere(rule: Rule) -> bool:
    """Whether a custom condition holds a query of its own."""
    return rule.type == "sql" and bool(_SUBQUERY.search(rule.params["condition"]))


@contextmanager
def visible(spark: SparkSession, tables: dict[str, DataFrame], day: date | None = None) -> Iterator[None]:
    """Within this, conditions can name the loads of `tables` (of one `day`): as `payments` or `t_payments`. Names are bound when a
    condition is analysed. Temporary views of the same names are put back at the end."""
    before: dict[str, DataFrame | None] = {}
    for name, df in tables.items():
        load = df if day is None else df.where(F.col("load_date") == F.lit(day))
        for view in (f"`{name}`", f"`t_{name}`"):
            known = spark.catalog.tableExists(view) and spark.catalog.getTable(view).isTemporary
            before.setdefault(view, spark.table(view) if known else None)
            load.createOrReplaceTempView(view)
    try:
        yield
    finally:
        for view, df in before.items():
            if df is None:
                spark.catalog.dropTempView(view.strip("`"))
            else:
                df.createOrReplaceTempView(view)


def stats_by_day(df: DataFrame, spec: TableSpec, rules: list[Rule], tables: dict[str, DataFrame], days: list[date]) -> DataFrame:
    """Statistics of conditions that look into other tables: the load of each day against the others' loads of that day."""
    parts = []
    for day in days:  # calendar days of a publication
        with visible(df.sparkSession, tables, day):
            parts.append(_of_table(_fused_stats(df.where(F.col("load_date") == F.lit(day)), spec, rules).where("kind = 'row'"), spec))
    return reduce(DataFrame.unionAll, parts)


# ------------------------------------------------------------------ results
def rule_facts(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """What check results say about their rules, one row per enabled rule of the catalogue."""
    rows = []
    for spec in catalog.tables:
        for i, r in enumerate(catalog.rules_for(spec.name)):
            p = r.params
            rows.append((spec.name, r.id, MONITOR_CHECKS + i, describe(r), r.severity, r.type,
                         float(p.get("max_pct") or 0), " + ".join(p.get("columns", [])), p.get("aggregate"),
                         p.get("column"), float(p.get("z") or 3), bool(p.get("same_weekday", True)), rule_sql(r, spec)))
    schema = ("table string, check_id string, check_order int, name string, severity string, rule_type string, "
              "max_pct double, key_names string, aggregate string, column string, z double, same_weekday boolean, sql string")
    return small_frame(spark, rows, schema)


def row_results(stats: DataFrame, facts: DataFrame) -> DataFrame:
    """Check results of the row and uniqueness rules from the daily statistics."""
    joined = stats.where(F.col("kind").isin("row", "unique")).drop("kind").join(facts, ["table", "check_id"])
    bad, total = F.col("failing_rows"), F.col("total_rows")
    pct = F.when(total > 0, 100 * bad.cast("double") / total).otherwise(0.0)
    unique = F.col("rule_type") == "unique"
    fails = F.when(unique, bad > 0).otherwise((bad > 0) & (pct > F.col("max_pct")))
    said = F.when(unique & (bad > 0), F.concat(thousands(bad), F.lit(" repeated rows in "),
                                               thousands(F.col("repeated_groups")), F.lit(" values of "), "key_names")) \
        .when(unique, F.lit("No duplicates")) \
        .when(bad > 0, F.concat(thousands(bad), F.lit(" of "), thousands(total), F.lit(" rows fail ("),
                                F.format_string("%.2f", half_even(pct, 2)), F.lit("%)"))) \
        .otherwise(F.lit("Every row complies"))
    limit = F.when(unique, F.lit("0 repeated")) \
        .otherwise(F.concat(F.lit("≤ "), _short_number(F.col("max_pct")), F.lit("% of rows")))
    return joined.select(
        "load_date", "table", "check_id", "check_order", "name", F.lit("rule").alias("kind"), "severity", "rule_type",
        F.when(fails, FAIL).otherwise(OK).alias("status"),
        F.when(unique, bad.cast("double")).otherwise(half_even(pct, 3)).alias("value"),
        limit.alias("threshold"), said.alias("message"), "failing_rows", "total_rows", "sql")


def _short_number(col):
    return F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))


def error_results(days: DataFrame, spec: TableSpec, rules: list[Rule], reasons: dict[str, str]) -> DataFrame:
    """Status `error` on every load date for the rules that could not be evaluated."""
    order = {r.id: MONITOR_CHECKS + i for i, r in enumerate(rules)}
    broken = [F.struct(
        F.lit(spec.name).alias("table"), F.lit(r.id).alias("check_id"), F.lit(order[r.id]).alias("check_order"),
        F.lit(describe(r)).alias("name"), F.lit("rule").alias("kind"), F.lit(r.severity).alias("severity"),
        F.lit(r.type).alias("rule_type"), F.lit(ERROR).alias("status"), F.lit(None).cast("double").alias("value"),
        F.lit("").alias("threshold"), F.lit(f"The rule could not be evaluated: {reasons[r.id]}").alias("message"),
        F.lit(0).cast("bigint").alias("failing_rows"), F.col("total_rows").cast("bigint").alias("total_rows"),
        F.lit(rule_sql(r, spec)).alias("sql")) for r in rules if r.id in reasons]
    return days.select("load_date", F.inline(F.array(*broken)))


def split_by_analysis(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> tuple[list[Rule], dict[str, str]]:
    """Rules that can be planned, and the reason for each one that cannot."""
    try:  # all of them in one analysis; only a failure asks which
        _fused_stats(df, spec, [r for r in rules if r.type != "unique"]).schema
        return rules, {}
    except (AnalysisException, ValueError, KeyError):
        reasons = {r.id: e for r in rules if (e := analysis_error(df, r, spec)) is not None}
        return [r for r in rules if r.id not in reasons], reasons


# Classes of SQL states that an expression can raise on its data (cardinality, data, external routine).
DATA_STATES = ("21", "22", "38", "39")


def data_error(exc: Exception) -> str | None:
    """What a user's expression raised while it ran; None for anything else, such as a lost executor or a full disk."""
    state = getattr(exc, "getSqlState", lambda: None)()
    if state and state.startswith(DATA_STATES):
        return str(exc).splitlines()[0]
    cause = getattr(exc, "java_exception", None) or getattr(exc, "_origin", None)
    while cause is not None:
        state = cause.getSqlState() if hasattr(cause, "getClass") and _is_spark_error(cause) else None
        if state and state.startswith(DATA_STATES):
            return str(cause.getMessage()).splitlines()[0]
        cause = cause.getCause()
    return None


def _is_spark_error(cause) -> bool:
    kind = cause.getClass()
    while kind is not None:
        if any(i.getName() == "org.apache.spark.SparkThrowable" for i in kind.getInterfaces()):
            return True
        kind = kind.getSuperclass()
    return False


def split_by_execution(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> tuple[list[Rule], dict[str, str]]:
    """After a table's job failed on its data: halve the custom conditions, the only rules that can raise, until the broken
    ones are alone. Errors that no expression raised are passed on."""
    reasons: dict[str, str] = {}

    def search(suspects: list[Rule]) -> None:
        try:
            _fused_stats(df, spec, suspects).write.format("noop").mode("overwrite").save()
        except Exception as exc:
            said = data_error(exc)
            if said is None:
                raise
            if len(suspects) == 1:
                reasons[suspects[0].id] = said
                return
            search(suspects[:len(suspects) // 2])
            search(suspects[len(suspects) // 2:])

    custom = [r for r in rules if r.type == "sql"]
    if custom:
        search(custom)
    return [r for r in rules if r.id not in reasons], reasons


def evaluate_rules(df: DataFrame, spec: TableSpec, rules: list[Rule]) -> DataFrame:
    """Check results of all row and uniqueness rules over all load dates, broken rules as `error`."""
    usable, reasons = split_by_analysis(df, spec, rules)
    facts = rule_facts(df.sparkSession, Catalog((spec,), tuple(rules)))
    results = row_results(daily_stats(df, spec, [r for r in usable if r.type != "outlier"]), facts)
    if not reasons:
        return results
    days = df.groupBy("load_date").agg(F.count(F.lit(1)).alias("total_rows"))
    return results.unionByName(error_results(days, spec, rules, reasons))


# ----------------------------------------------------------------- examples
def failing_examples(df: DataFrame, spec: TableSpec, rules: list[Rule], n: int = 5) -> DataFrame:
    """Up to `n` bad rows per (load date, row rule), the first ones in column order, as JSON.

    One scan for all rules; ranks are cut before the shuffle, so a load full of bad rows stays cheap.
    """
    flags = {f"__bad_{i}": F.coalesce(bad_rows(r, spec), F.lit(False)) for i, r in enumerate(rules)}
    broken = F.explode(F.array(*[F.when(F.col(f"__bad_{i}"), F.lit(r.id)) for i, r in enumerate(rules)]))
    columns = [F.col(f"`{c}`") for c in spec.column_names]
    bad = df.withColumns(flags).where(reduce(lambda a, b: a | b, [F.col(f) for f in flags])) \
        .select("load_date", broken.alias("check_id"), F.struct(*columns).alias("record")).where("check_id is not null")
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{c.name}="), _evidence(F.col(f"record.`{c.name}`"), c.type))
                                for c in spec.columns])
    first = Window.partitionBy("load_date", "check_id").orderBy("record")
    return bad.withColumn("position", F.row_number().over(first)).where(F.col("position") <= n) \
        .select("load_date", F.lit(spec.name).alias("table"), "check_id", "position",
                F.to_json("record", {"ignoreNullFields": "false"}).alias("example"), shown.alias("shown"))


def _evidence(col, kind: str):
    return evidence_number(col) if kind in NUMERIC else F.coalesce(col.cast("string"), F.lit("NULL"))


def duplicate_examples(df: DataFrame, spec: TableSpec, rule: Rule, n: int = 5) -> DataFrame:
    """The `n` most repeated groups of each load date; ties in key order."""
    columns = rule.params["columns"]
    return _most_repeated(df, spec, columns, n).select("load_date", F.col("__position").alias("position"), *[F.col(f"`{c}`") for c in columns],
                                                       F.col("__times").alias("times"))


def _head(df: DataFrame, column: str) -> Column:
    """A column's values, of texts and nested values the beginning, to order ties by."""
    short = isinstance(df.schema[column].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))
    return F.col(f"`{column}`") if short else F.substring(F.col(f"`{column}`").cast("string"), 1, TIE_CHARACTERS)


def _most_repeated(df: DataFrame, spec: TableSpec, columns: list[str], n: int) -> DataFrame:
    """Ranks name every group apart, so that Spark cuts to `n` a task and load date before it shuffles, however many groups are tied.
    Of long keys, the columns' first `TIE_CHARACTERS` and then the digest order the ties."""
    repeated = F.desc("__times")
    if _long_key(spec, columns):
        heads = {f"__head_{i}": _head(df, c) for i, c in enumerate(columns)}
        groups = df.groupBy("load_date", _key_digest(columns).alias("__key")).agg(F.expr("count(1) AS __times"), *[F.min(h).alias(k) for k, h in heads.items()])
        order = [repeated, *[F.asc_nulls_first(k) for k in heads], F.asc("__key")]
    else:
        groups, order = key_groups(df, columns, False), [repeated, *[F.asc_nulls_first(f"`{c}`") for c in columns]]
    ranked = Window.partitionBy("load_date").orderBy(*order)
    top = groups.where("__times > 1").withColumn("__position", F.row_number().over(ranked)).where(F.col("__position") <= n)
    return _with_texts(df, columns, top.select("load_date", "__key", "__times", "__position")) if _long_key(spec, columns) else top


def failing_evidence(df: DataFrame, spec: TableSpec, rules: list[Rule], n: int = 5) -> DataFrame | None:
    """What is shown of failing checks, as (load_date, table, check_id, position, shown): bad rows, or repeated keys and how often."""
    columns = ["load_date", "table", "check_id", "position", "shown"]
    row_rules = [r for r in rules if r.type in ROW_RULES]
    parts = [failing_examples(df, spec, row_rules, n).select(columns)] if row_rules else []
    for r in (r for r in rules if r.type == "unique"):
        keys = r.params["columns"]
        said = F.concat(F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))) for c in keys]),
                        F.lit(" (x"), F.col("__times").cast("string"), F.lit(")"))
        parts.append(_most_repeated(df, spec, keys, n).select(
            "load_date", F.lit(spec.name).alias("table"), F.lit(r.id).alias("check_id"), F.col("__position").alias("position"), said.alias("shown")))
    return reduce(DataFrame.unionByName, parts) if parts else None


# ----------------------------------------------------- budget for custom SQL
def within_budget(spark: SparkSession, action: Callable[[], Any], seconds: float) -> Any:
    """Result of `action`; the Spark jobs it starts are cancelled with TimeoutError after `seconds`."""
    context = spark.sparkContext
    tag = f"budget-{uuid.uuid4().hex}"
    outcome: dict[str, Any] = {}

    def work():
        context.addJobTag(tag)
        try:
            outcome["result"] = action()
        except Exception as exc:
            outcome["error"] = exc
        finally:
            context.removeJobTag(tag)

    worker = InheritableThread(target=work)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        context.cancelJobsWithTag(tag)
        worker.join(10)
        raise TimeoutError(f"the query exceeded {seconds:g} s and was cancelled")
    if "error" in outcome:
        raise outcome["error"]
    return outcome["result"]


class BudgetedRows(list):
    """Rows of a user query; `truncated` says that there were more than the budget allows."""

    truncated = False


def run_budgeted(df: DataFrame, seconds: float, max_rows: int = 1000) -> BudgetedRows:
    """Rows of a user query, at most `max_rows` (`truncated` if it has more); cancelled with TimeoutError after `seconds`."""
    got = within_budget(df.sparkSession, lambda: df.limit(max_rows + 1).collect(), seconds)
    rows = BudgetedRows(got[:max_rows])
    rows.truncated = len(got) > max_rows
    return rows


def budgeted_sql_stats(spark: SparkSession, stats_of: Callable[[list[Rule]], DataFrame], rules: list[Rule], seconds: float) -> tuple[list[DataFrame], dict[str, str]]:
    """Statistics of custom SQL rules that all share one scan of `seconds`; and why some gave none. Only if the scan takes longer, or an
    expression fails, the rules are halved, until those to blame are alone, each with `seconds` of its own."""
    done, reasons = [], {}

    def attempt(some: list[Rule]) -> None:
        stats = stats_of(some)
        try:
            done.append(within_budget(spark, lambda: stage(stats, "sql-rules"), seconds))
        except Exception as exc:
            said = str(exc) if isinstance(exc, TimeoutError) else data_error(exc)
            if said is None:
                raise
            if len(some) == 1:
                reasons[some[0].id] = said
                return
            attempt(some[:len(some) // 2])
            attempt(some[len(some) // 2:])

    if rules:
        attempt(rules)
    return done, reasons


def preview_rule(df: DataFrame, spec: TableSpec, rule: Rule, seconds: float = 30.0) -> dict[str, Any]:
    """Evaluate a rule on the latest load without saving anything."""
    latest = df.agg(F.max("load_date").alias("d")).first()["d"]
    if latest is None:
        raise ValueError("there are no recent loads of this table to try the rule on")
    load = df.where(F.col("load_date") == F.lit(latest))
    shown = {"date": latest, "check_id": "preview", "name": describe(rule), "severity": rule.severity,
             "sql": rule_sql(rule, spec, latest)}
    if rule.type == "outlier":
        row = load.agg(daily_value(rule).alias("v"), F.count(F.lit(1)).alias("n")).first()
        return {**shown, "status": OK, "value": row["v"], "total_rows": row["n"], "examples": [],
                "message": f"Value of {latest}: {row['v']:,.2f}. It will be compared with its history from the next load on."}
    try:
        result = run_budgeted(evaluate_rules(load, spec, [rule]), seconds)[0]
        examples = []
        if result["failing_rows"] and rule.type == "unique":
            examples = [r.asDict() for r in run_budgeted(duplicate_examples(load, spec, rule), seconds)]
        elif result["failing_rows"]:
            order = [F.col(f"`{c}`") for c in spec.column_names]
            examples = [r.asDict() for r in
                        run_budgeted(load.where(bad_rows(rule, spec)).orderBy(*order).select(*order).limit(5), seconds)]
    except Exception as exc:
        return {**shown, "status": ERROR, "value": None, "total_rows": None, "examples": [],
                "message": f"The rule could not be evaluated: {str(exc).splitlines()[0]}"}
    return {**shown, **{k: result[k] for k in ("status", "value", "threshold", "message", "failing_rows", "total_rows")},
            "examples": examples}
