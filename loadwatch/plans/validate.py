"""Validation of loads: monitors, rules, baselines, scores and observations in a few jobs for all tables and days."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwatch.model import CHECK_COLUMNS, Catalog, Rule, specs_frame
from loadwatch.operators.baseline import (metrics_of, outlier_results, outlier_series, replay, score_new_loads,
                                          volume_results, volume_series)
from loadwatch.operators.evaluate import (budgeted_sql_stats, daily_stats, data_error, error_results, fill_days, further_stats,
                                          looks_elsewhere, row_results, rule_facts, split_by_analysis, split_by_execution,
                                          stats_by_day, visible)
from loadwatch.operators.incidents import observations
from loadwatch.operators.monitors import availability, structure
from loadwatch.operators.score import score_metrics, table_scores
from loadwatch.session import stage
from loadwatch.sources.connector import align_to_spec


UNLIMITED = 30 * 86400.0  # seconds; a pass without a limit


@dataclass(frozen=True)
class Validation:
    """Results of validating some loads; every frame is small (per table, check and day)."""

    checks: DataFrame
    bands: DataFrame
    stats: DataFrame
    scores: DataFrame
    metrics: DataFrame
    observations: DataFrame


def collect_stats(catalog: Catalog, tables: dict[str, DataFrame], delivered: DataFrame | None = None,
                  sql_seconds: float | None = None, observed: dict[str, DataFrame] | None = None):
    """Daily statistics of every table; and the rules that could not be evaluated, by table.

    A rule that cannot be planned is left out at once. All tables run in one job; if an expression fails on its data, every
    table with custom conditions becomes a job of its own, and within a table that fails the conditions are halved until the
    broken ones are alone. Tables without custom conditions are not read again. Errors that no expression raised (a lost
    executor, a full disk) are passed on. With `sql_seconds`, the custom SQL rules of a table leave the fused pass for one of their own that has that long
    to finish. Conditions that hold a query see the loads of all `tables` of their own day by name. `observed` has the statistics that the
    write of a load already gave: what is left to read there are uniqueness rules and custom conditions.
    """
    observed = observed or {}
    aligned = {name: align_to_spec(df, catalog.spec(name)) for name, df in tables.items()}
    if any(looks_elsewhere(r) for name in tables for r in catalog.rules_for(name)):
        with visible(next(iter(tables.values())).sparkSession, aligned):  # for the analysis; values are bound day by day
            return _collect(catalog, aligned, delivered, sql_seconds, observed)
    return _collect(catalog, aligned, delivered, sql_seconds, observed)


def _collect(catalog: Catalog, aligned: dict[str, DataFrame], delivered: DataFrame | None, sql_seconds: float | None,
             observed: dict[str, DataFrame]):
    reasons: dict[str, dict[str, str]] = {}
    usable: dict[str, list[Rule]] = {}
    parts: dict[str, list[DataFrame]] = {}
    apart: dict[str, list[Rule]] = {}  # rules evaluated outside the shared pass

    def custom(name: str, rules: list[Rule]) -> None:
        """Custom conditions with a pass of their own; those with queries against the day's other loads."""
        df, spec = aligned[name], catalog.spec(name)
        inside, across = [r for r in rules if not looks_elsewhere(r)], [r for r in rules if looks_elsewhere(r)]
        kinds = [(inside, lambda some: daily_stats(df, spec, some).where(F.col("kind") == "row"))]
        if across:
            days = sorted(r["load_date"] for r in df.select("load_date").distinct().collect() if r["load_date"])
            kinds += [(across, lambda some: stats_by_day(df, spec, some, aligned, days))] if days else []
        for own, stats_of in kinds:
            made, late = budgeted_sql_stats(df.sparkSession, stats_of, own, UNLIMITED if sql_seconds is None else sql_seconds)
            parts[name] += made
            reasons[name] |= late
        usable[name] = [r for r in usable[name] if r.id not in reasons[name]]
        apart[name] = [r for r in rules if r.id not in reasons[name]]

    for name, df in aligned.items():
        spec = catalog.spec(name)
        usable[name], reasons[name] = split_by_analysis(df, spec, catalog.rules_for(name))
        parts[name], apart[name] = [observed[name]] if name in observed else [], []
        custom(name, [r for r in usable[name] if r.type == "sql" and (sql_seconds is not None or looks_elsewhere(r))])

    def stats_of(name: str) -> DataFrame:
        fused = [r for r in usable[name] if r not in apart[name]]
        spec = catalog.spec(name)
        new = further_stats(aligned[name], spec, fused) if name in observed else [daily_stats(aligned[name], spec, fused)]
        return reduce(DataFrame.unionByName, [*parts[name], *new])

    def at_risk(name: str) -> bool:
        return any(r.type == "sql" and r not in apart[name] for r in usable[name])

    safe, risky = [n for n in aligned if not at_risk(n)], [n for n in aligned if at_risk(n)]
    done = [stage(reduce(DataFrame.unionByName, map(stats_of, names)), "stats") for names in [safe] if names and risky]
    if not risky:
        done = [reduce(DataFrame.unionByName, map(stats_of, safe))]
    elif (together := _tried(reduce(DataFrame.unionByName, map(stats_of, risky)))) is not None:
        done.append(together)
    else:
        for name in risky:
            one = _tried(stats_of(name)) if len(risky) > 1 else None
            if one is None:
                _, broken = split_by_execution(aligned[name], catalog.spec(name), [r for r in usable[name] if r not in apart[name]])
                usable[name] = [r for r in usable[name] if r.id not in broken]
                reasons[name] |= broken
                one = stage(stats_of(name), "stats")
            done.append(one)
    stats = reduce(DataFrame.unionByName, done)
    stats = stats if delivered is None else fill_days(stats, delivered, usable)
    return stage(stats, "stats"), reasons


def _tried(stats: DataFrame) -> DataFrame | None:
    """The statistics, staged, or None if an expression failed on its data."""
    try:
        return stage(stats, "stats")
    except Exception as exc:
        if data_error(exc) is None:
            raise
        return None


def validate(catalog: Catalog, tables: dict[str, DataFrame], arrivals: DataFrame, received: DataFrame,
             history: DataFrame | None = None, sql_seconds: float | None = None, one_day: bool = False,
             observed: dict[str, DataFrame] | None = None) -> Validation:
    """Validate every load of `tables` (frames tagged with `load_date`), all days and tables together.

    `arrivals`: load_date, table, arrived_minute (NULL when missing), now_minute and optionally published, seq,
    run_id. `received`: load_date, table, columns. `history`: clean points of earlier validations. `sql_seconds`: time
    the custom SQL rules of a table may take. `one_day`: every series has one new point at most, which is scored against the history without
    walking it and without Python workers. `observed`: statistics of tables whose write was observed.
    """
    spark = arrivals.sparkSession
    specs, facts = specs_frame(spark, catalog), rule_facts(spark, catalog)
    delivered = arrivals.where("arrived_minute is not null").select("load_date", "table")
    stats, reasons = collect_stats(catalog, tables, delivered, sql_seconds, observed)
    series = outlier_series(stats, facts).unionByName(volume_series(stats, specs))
    alone = one_day and history is not None
    bands = stage(score_new_loads(history, series) if alone else replay(series, history), "bands")
    totals = stats.where(F.col("kind") == "rows").select("table", "load_date", F.col("total_rows").alias("row_count"))
    parts = [availability(arrivals, specs), volume_results(bands), structure(received, specs),
             row_results(stats, facts), outlier_results(bands, facts, totals)]
    for name, failed in reasons.items():
        if failed:
            days = stats.where((F.col("kind") == "rows") & (F.col("table") == name))
            parts.append(error_results(days, catalog.spec(name), catalog.rules_for(name), failed))
    checks = stage(reduce(DataFrame.unionByName, [p.select(*CHECK_COLUMNS) for p in parts]), "checks")
    missing = arrivals.where("arrived_minute is null")
    scores = table_scores(checks, missing)
    metrics = metrics_of(bands).unionByName(score_metrics(scores))
    minutes = arrivals.withColumn("minute", F.coalesce("arrived_minute", "now_minute"))
    extra = [c for c in ("seq", "run_id") if c in arrivals.columns]
    seen = observations(checks, minutes.select("load_date", "table", "minute", *extra))
    return Validation(checks, bands, stats, scores, metrics, seen)
