"""The monitor of one source: validates its publications and answers questions about its tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadwatch.model import Catalog, Rule, small_frame, specs_frame
from loadwatch.operators import incidents as inc
from loadwatch.operators.baseline import base_points, clean_history, expected_rows
from loadwatch.operators.evaluate import Observed, failing_evidence, looks_elsewhere, preview_rule, split_by_analysis, visible
from loadwatch.operators.monitors import overdue_source
from loadwatch.operators.profile import profile, suggest_rules
from loadwatch.operators.rules import validate_rule
from loadwatch.operators.sketches import load_sketches, merged_profile
from loadwatch.plans import report
from loadwatch.plans.escalation import escalation_reports
from loadwatch.plans.validate import validate
from loadwatch.session import stage, temporary
from loadwatch.sources.connector import Connector, align_to_spec, available_dates, path_exists
from loadwatch.sources.publications import fingerprint, parse_manifest, plan_dates, publication_log, read_manifest
from loadwatch.sources.rulebook import keep_rules, kept_rules, next_id
from loadwatch.sources.store import DAYS_HISTORY, DAYS_ROWS, Store
from loadwatch.streaming.ingest import watch_publications

EXAMPLES = 5  # bad rows or repeated groups kept with a failing check


@dataclass
class Monitor:
    """A connector and the store of its results. Holds no data: every call reads the store.

    `sql_seconds` is the time the custom SQL rules of a table may take together, and each alone if they take longer (None: no limit, and
    they share the scan of the other rules); a condition may query the other tables of the connector by name, and sees their loads of the same day;
    `row_days` and `history_days` say how long rows, and metrics with check results, are kept. With `sketches`, every load leaves a
    profile that adds up (one more aggregation over its rows), which `profile_between` reads long after the rows have gone.
    """

    spark: SparkSession
    connector: Connector
    store: Store
    rules: tuple[Rule, ...] = ()
    sql_seconds: float | None = 300.0
    row_days: int = DAYS_ROWS
    history_days: int = DAYS_HISTORY
    sketches: bool = False

    def __post_init__(self) -> None:
        if not self.rules:
            kept = kept_rules(self.spark, f"{self.store.root}/rules")
            self.rules = self.connector.catalog.rules if kept is None else tuple(kept)
        self.rules = tuple(validate_rule(r, self.connector.catalog) for r in self.rules)

    @property
    def catalog(self) -> Catalog:
        return replace(self.connector.catalog, rules=self.rules)

    def _manifest(self) -> DataFrame | None:
        if not self.connector.manifest:
            return None
        path = f"{self.connector.path}/{self.connector.manifest}"
        return read_manifest(self.spark, path) if path_exists(self.spark, path) else None

    def publication(self) -> DataFrame | None:
        """The current publication as manifest rows; without a manifest, the files' own time and its date."""
        manifest = self._manifest()
        if manifest is not None and not manifest.isEmpty():
            return manifest
        stamp = fingerprint(self.spark, None, list(self.connector.files.values()))
        times = stamp.select(F.timestamp_seconds(F.regexp_extract("fingerprint", r"(\d+)", 1).cast("bigint")).alias("t")) \
            .select(F.lit(None).cast("string").alias("run_id"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
                    F.lit(None).cast("array<string>").alias("dates"), F.lit(None).cast("map<string,bigint>").alias("datasets"))
        return parse_manifest(times)

    def sync(self, published: DataFrame | None = None) -> list[date]:
        """Validate what the source has published since the last call; the dates validated, none if nothing changed.

        `published` are manifest rows, one or several publications; by default those the source shows now. Every publication
        that was not processed yet is, in the order of their times.
        """
        published = self.publication() if published is None else published
        if published is None:
            return []
        seen = self.store.read("publications").select(F.col("fingerprint").alias("published_at")).distinct()
        heads = published.join(seen, "published_at", "left_anti").groupBy("published_at").agg(
            F.min("published").alias("published"), F.min("published_minute").alias("published_minute"),
            F.max("run_id").alias("run_id"), F.any_value("datasets").alias("datasets")).orderBy("published", "published_at").collect()
        days: set[date] = set()
        for head in heads:  # one row per publication
            with temporary(self.spark):
                days |= set(self._sync_one(published, head))
        return sorted(days)

    def _sync_one(self, published: DataFrame, head) -> list[date]:
        log = self.store.read("publications")
        last = log.orderBy(F.desc("seq")).select("seq").first()
        dates = published.where(F.col("published_at") == head["published_at"]).select(F.explode("dates").alias("load_date"))
        available = None
        if last is None:
            dated = [(self.connector.current(self.spark, s.name)[0], s) for s in self.catalog.tables if s.load_type == "incremental" and s.date_column]
            available = available_dates([(df, s) for df, s in dated if df is not None])
        planned = plan_dates(dates, available, log, first_connection=last is None)
        days = sorted(r["load_date"] for r in planned.collect())  # calendar days
        if days:
            self._validate_days(days, head, self._next_seq())
        return days

    def watch(self, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Validate each new manifest of `folder` as it appears, in order and once."""
        return watch_publications(self.spark, folder, lambda manifest, _: self.sync(manifest), checkpoint, trigger)

    def _next_seq(self) -> int:
        """Processing order: one more than the last one logged. What an interrupted run left is overwritten."""
        return (self.store.read("publications").agg(F.max("seq").alias("seq")).first()["seq"] or 0) + 1

    def _validate_days(self, days: list[date], head, seq: int) -> None:
        spark, connector = self.spark, self.connector
        calendar = small_frame(spark, [(d,) for d in days], "load_date date")
        tables, received = {}, []
        for spec in self.catalog.tables:
            df, columns = connector.current(spark, spec.name)
            if df is None:
                df = spark.createDataFrame([], connector.schemas[spec.name])
            if spec.load_type == "incremental":
                due = days
                if spec.date_column in df.columns:
                    day = F.col(f"`{spec.date_column}`").cast("date")
                    in_range = df.where((day >= F.lit(days[0])) & (day <= F.lit(days[-1]))).withColumn("load_date", day)
                    tables[spec.name] = in_range.join(calendar, "load_date", "left_semi")
                else:  # the date column is gone: every date receives the whole table
                    each = F.explode(F.array(*[F.lit(d) for d in days]))
                    tables[spec.name] = df.withColumn("load_date", each)
            else:
                due = days[-1:]
                tables[spec.name] = df.withColumn("load_date", F.lit(days[-1]))
            received += [(d, spec.name, columns) for d in due]
        self._suggest(tables, days)
        shape = small_frame(spark, received, "load_date date, table string, columns array<string>")
        arrivals = shape.select("load_date", "table", F.lit(head["published_minute"]).alias("arrived_minute"),
                                F.lit(head["published_minute"]).alias("now_minute"),
                                F.lit(head["published"]).cast("timestamp").alias("published"),
                                F.lit(seq).cast("bigint").alias("seq"), F.lit(head["run_id"]).cast("string").alias("run_id"))
        # Rows retention would drop at once are validated from the source and never stored.
        first_kept = days[-1] - timedelta(days=self.row_days)
        loads, watched = {}, {}
        for spec in self.catalog.tables:
            aligned = align_to_spec(tables[spec.name], spec)
            due = days if spec.load_type == "incremental" else days[-1:]
            kept = [d for d in due if d >= first_kept]
            fresh = aligned.where(F.col("load_date") >= F.lit(first_kept))
            if len(due) == len(kept) == 1:  # the job that stores the rows of a single day measures them too
                usable, _ = split_by_analysis(aligned, spec, [r for r in self.catalog.rules_for(spec.name) if r.type not in ("unique", "sql")])
                watched[spec.name] = (Observed(fresh, spec, usable), kept[0])
                fresh = watched[spec.name][0].rows
            self.store.write_load(fresh, spec, kept)
            stored = self.store.rows(spec).where(F.col("load_date").isin(kept))
            older = aligned.where(F.col("load_date") < F.lit(first_kept))
            loads[spec.name] = stored if len(kept) == len(due) else stored.unionByName(older)
        # The points that days before the first new one are remembered by, and later ones if an earlier day comes again.
        metrics, own = self.store.read("metrics"), ["load_date", "table", "metric", "value"]
        since = clean_history(metrics, F.lit(days[0])).select(own).unionByName(metrics.where(F.col("load_date") >= F.lit(days[0])).select(own))
        history = stage(base_points(since), "history")
        observed = {name: seen.stats(spark, day) for name, (seen, day) in watched.items()}
        v = validate(self.catalog, loads, arrivals, shape, history, self.sql_seconds, one_day=len(days) == 1, observed=observed)
        counts = v.stats.where(F.col("kind") == "rows").select("load_date", "table", F.col("total_rows").alias("row_count"))
        delivered = arrivals.join(counts, ["load_date", "table"], "left").join(shape, ["load_date", "table"]) \
            .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
        self.store.write("loads", delivered)
        self.store.write("check_results", v.checks)
        self.store.write("metrics", v.metrics)
        self.store.write("observations", v.observations)
        self.store.clear("examples", arrivals)
        examples = self._evidence(v.checks, loads, first_kept)
        if examples is not None:
            self.store.write("examples", examples)
        self.store.clear("profiles", arrivals)
        if self.sketches:
            profiles = [load_sketches(loads[spec.name], spec) for spec in self.catalog.tables]
            self.store.write("profiles", reduce(DataFrame.unionByName, profiles))
        datasets = F.lit(None).cast("map<string,bigint>") if head["datasets"] is None else F.create_map(
            *[F.lit(x) for pair in head["datasets"].items() for x in pair]).cast("map<string,bigint>")
        self.store.write("publications", calendar.select(
            datasets.alias("datasets"),
            F.lit(seq).cast("bigint").alias("seq"), F.lit(head["run_id"]).cast("string").alias("run_id"),
            F.lit(head["published_at"]).alias("published_at"), F.lit(head["published"]).cast("timestamp").alias("published"),
            F.lit(head["published_at"]).alias("fingerprint"), "load_date"))
        self.store.apply_retention(list(self.catalog.tables), days[-1], self.row_days, self.history_days, days)
        if firsts := [d for d in days if d.day == 1]:
            self._settle(max(firsts) - timedelta(days=self.history_days))

    def _evidence(self, checks: DataFrame, loads: dict[str, DataFrame], first_kept: date) -> DataFrame | None:
        """The first bad rows and the most repeated groups of every check that fails, from the load it fails on; of conditions over other
        tables, which need a plan for each day, from the loads whose rows are kept."""
        failing = stage(checks.where(F.col("status") == "fail").select("load_date", "table", "check_id"), "failing")
        named = {(r["table"], r["check_id"]) for r in failing.select("table", "check_id").distinct().collect()}  # rules
        out = []
        for spec in self.catalog.tables:
            broken = [r for r in self.catalog.rules_for(spec.name) if (spec.name, r.id) in named]
            own = failing.where(F.col("table") == spec.name)
            df = loads[spec.name].join(own.select("load_date").distinct(), "load_date", "left_semi")
            shown = failing_evidence(df, spec, [r for r in broken if not looks_elsewhere(r)], EXAMPLES)
            out += [] if shown is None else [shown]
            if across := [r for r in broken if looks_elsewhere(r)]:
                wrong = own.where(F.col("check_id").isin([r.id for r in across]) & (F.col("load_date") >= F.lit(first_kept))).select("load_date").distinct().collect()  # calendar days
                for day in sorted(r["load_date"] for r in wrong):
                    with visible(self.spark, loads, day):
                        out.append(failing_evidence(df.where(F.col("load_date") == F.lit(day)), spec, across, EXAMPLES))
        return reduce(DataFrame.unionByName, out).join(failing, ["load_date", "table", "check_id"], "left_semi") if out else None

    def _suggest(self, tables: dict[str, DataFrame], days: list[date]) -> None:
        """Tables without rules get suggested ones from their first delivered load that has rows, once."""
        for spec in self.catalog.tables:
            if spec.name not in self.connector.auto_rules or self.catalog.rules_for(spec.name, enabled_only=False):
                continue
            first = tables[spec.name].agg(F.min("load_date")).first()[0]
            if first is None:  # nothing has come yet: a later publication may
                continue
            load = align_to_spec(tables[spec.name].where(F.col("load_date") == F.lit(first)), spec)
            for raw in suggest_rules(load, spec):
                try:
                    rule = validate_rule(Rule.from_dict(raw, id=next_id(list(self.rules)), author="suggested"), self.catalog)
                except ValueError:
                    continue
                self.rules = (*self.rules, rule)
        keep_rules(self.spark, list(self.rules), f"{self.store.root}/rules")

    def check_overdue(self, as_of: datetime) -> bool:
        """Record the failure of every table when the source is overdue; once per day."""
        log = self.store.read("publications")
        checks = overdue_source(log, self.specs, as_of, self.connector.title)
        today = self.store.read("observations").where(F.col("load_date") == F.lit(as_of.date()))
        if checks.isEmpty() or not today.where(F.exists("checks", lambda c: c["check_id"] == "availability")).isEmpty():
            return False
        seq = F.lit(self._next_seq()).cast("bigint").alias("seq")
        minutes = checks.select("load_date", "table", F.lit(as_of.hour * 60 + as_of.minute).alias("minute"), seq)
        self.store.write("observations", inc.observations(checks, minutes))
        # The log keeps its order: a notice repeats the last publication, without dates.
        last = log.orderBy(F.desc("seq")).limit(1)
        self.store.write("publications", stage(last.withColumns({"seq": seq, "load_date": F.lit(None).cast("date")}), "notice"))
        return True

    # ---------------------------------------------------------------- rules
    def _save_rules(self, rules: list[Rule]) -> None:
        self.rules = tuple(rules)
        keep_rules(self.spark, rules, f"{self.store.root}/rules")

    def add_rule(self, raw: dict[str, Any]) -> Rule:
        """Validate and keep a rule; without an id it gets the next number."""
        rule = validate_rule(Rule.from_dict(raw, id=raw.get("id") or next_id(list(self.rules))), self.catalog)
        self._save_rules([r for r in self.rules if r.id != rule.id] + [rule])
        return rule

    def update_rule(self, rule_id: str, **changes: Any) -> Rule:
        """Change a rule (for example `enabled=False`); its id stays."""
        rule = validate_rule(replace(self._rule(rule_id), **changes, id=rule_id), self.catalog)
        self._save_rules([rule if r.id == rule_id else r for r in self.rules])
        return rule

    def delete_rule(self, rule_id: str) -> None:
        gone = self._rule(rule_id)
        self._save_rules([r for r in self.rules if r != gone])

    def _rule(self, rule_id: str) -> Rule:
        for r in self.rules:
            if r.id == rule_id:
                return r
        raise ValueError(f"rule '{rule_id}' does not exist")

    def preview(self, raw: dict[str, Any], seconds: float = 30.0) -> dict[str, Any]:
        """Try a rule on the latest stored load of its table."""
        rule = validate_rule(Rule.from_dict(raw, id="preview"), self.catalog)
        spec = self.catalog.spec(rule.table)
        rows = self.store.rows(spec)
        if not looks_elsewhere(rule):
            return preview_rule(rows, spec, rule, seconds)
        newest = rows.agg(F.max("load_date")).first()[0]
        with visible(self.spark, {s.name: self.store.rows(s) for s in self.catalog.tables}, newest):
            return preview_rule(rows, spec, rule, seconds)

    # ------------------------------------------------------------ incidents
    @property
    def specs(self) -> DataFrame:
        return specs_frame(self.spark, self.catalog)

    def incidents(self) -> DataFrame:
        """Every incident that retention keeps, with the run that brought the failing load and its link."""
        obs, actions, closed = self._events()
        found = inc.incidents(obs, actions, self.specs, closed)
        newest = self.store.read("publications").agg(F.max("load_date")).scalar()
        return inc.with_runs(inc.keep_recent(found, F.coalesce(newest, F.current_date())), self.runs())

    def runs(self) -> DataFrame:
        """One row per publication validated so far."""
        log = self.store.read("publications").where("load_date is not null").groupBy("seq", "run_id", "published_at").agg(
            F.collect_set("load_date").alias("dates"), F.any_value("datasets").alias("datasets"))
        published = F.try_to_timestamp("published_at")
        return publication_log(log.select(
            "run_id", "published_at", F.to_date(published).alias("published_date"),
            (F.hour(published) * 60 + F.minute(published)).alias("published_minute"), F.array_sort("dates").alias("dates"),
            "datasets"), self.connector.run_url)

    def timeline(self) -> DataFrame:
        obs, actions, closed = self._events()
        return inc.timeline(obs, self.specs, actions, closed)

    def _events(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Observations and actions that still matter, and the incidents settled before them."""
        closed = self.store.read("closed_incidents")
        return inc.after_closed(self.store.read("observations"), closed), inc.after_closed(self.store.read("actions"), closed, 1), closed

    def _settle(self, before: date) -> None:
        """Incidents that ended before that day become rows; observations that no other incident needs go."""
        obs, actions, _ = self._events()
        old = stage(inc.settled(obs, actions, F.lit(before)), "settled")
        if not old.isEmpty():
            self.store.append("closed_incidents", old)
        obs, actions, _ = self._events()
        self.store.drop_publications("observations", before, inc.still_needed(obs, actions))

    def reports(self) -> DataFrame:
        """The message for the owner of each open incident, with the rows that its newest failing load has kept."""
        checks = self.store.read("check_results")
        open_now = stage(inc.recurrence(self.incidents().where("resolved_date is null"), checks), "incidents")
        since = self.store.read("examples").join(open_now.select("table", "opened_date"), "table").where("load_date >= opened_date")
        newest = Window.partitionBy("table", "check_id").orderBy(F.desc("load_date"))
        kept = since.withColumn("age", F.dense_rank().over(newest)).where("age = 1").select("table", "check_id", "position", "shown")
        return escalation_reports(open_now, self.specs, kept)

    def escalate(self, table: str, actor: str = "analyst") -> None:
        """Escalate the incident of a table: it stays open, and the story says who did it."""
        self._act(table, "escalate", "", actor)

    def resolve(self, table: str, note: str = "", actor: str = "analyst") -> None:
        """Resolve the open incident of a table by hand."""
        self._act(table, "resolve", note, actor)

    def _act(self, table: str, action: str, note: str, actor: str) -> None:
        seen = self.store.read("observations").where(F.col("table") == self.catalog.spec(table).name)
        now = F.struct("seq", "load_date", "minute")  # the clock of a connector is that of its data
        act = seen.agg(F.max(now).alias("now")).where("now is not null").select(
            "now.*", F.lit(table).alias("table"), F.lit(action).alias("action"), F.lit(note).alias("note"), F.lit(actor).alias("actor"))
        self.store.append("actions", act)

    # -------------------------------------------------------------- reading
    def _arrivals(self) -> DataFrame:
        return self.store.read("loads").select("load_date", "table", "arrived_minute", F.col("arrived_minute").alias("now_minute"))

    def summary(self, shown: DataFrame | None = None) -> DataFrame:
        """One row per table and load; `shown` (table, load_date) names those that are asked for."""
        loads, checks, metrics = self.store.read("loads"), self.store.read("check_results"), self.store.read("metrics")
        if shown is not None:
            loads = loads.join(shown, ["table", "load_date"], "left_semi")
        scores = metrics.where((F.col("metric") == "score") & (F.col("table") != "_global")) \
            .select("load_date", "table", F.col("value").alias("score"))
        asked = loads.select("load_date", "table").join(self.specs.select("table", "load_type"), "table")
        arrivals = loads.select("load_date", "table", "arrived_minute", F.col("arrived_minute").alias("now_minute"))
        return report.table_summary(self.specs, arrivals, checks, scores, metrics,
                                    expected_rows(base_points(metrics), asked), loads)

    def latest_summary(self) -> DataFrame:
        """The newest load of each table."""
        return self.summary(self.store.read("loads").groupBy("table").agg(F.max("load_date").alias("load_date")))

    def kpis(self) -> DataFrame:
        """The newest day in one row; before the first publication, today without loads."""
        loads = self.store.read("loads")
        newest = loads.agg(F.max(F.struct("load_date", "arrived_minute")).alias("now")).first()["now"]
        if newest is None:
            newest = {"load_date": date.today(), "arrived_minute": 0}
        of_day = loads.where(F.col("load_date") == F.lit(newest["load_date"])).select("table", "load_date")
        return report.kpi_snapshot(self.summary(of_day), self.store.read("check_results"), self.incidents(),
                                   newest["load_date"], newest["arrived_minute"])

    def snapshot(self) -> dict[str, DataFrame]:
        """What a front page shows: indicators, tables, the first 40 incidents, the score series and the log."""
        metrics = self.store.read("metrics")
        return {"kpis": self.kpis(), "tables": self.latest_summary(), "incidents": inc.incident_list(self.incidents()),
                "score_series": report.score_series(metrics),
                "events": report.validation_log(self._arrivals(), self.specs, self.store.read("check_results"),
                                                self.store.read("loads"), self.timeline()),
                "publications": self.runs()}

    def table_detail(self, table: str) -> dict[str, DataFrame]:
        """What a table's page shows; `outlier:<rule>` holds the band of each outlier rule."""
        spec = self.catalog.spec(table)
        metrics, checks = self.store.read("metrics"), self.store.read("check_results")
        own = checks.where(F.col("table") == table)
        newest = own.agg(F.max("load_date")).scalar()
        rows = self.store.rows(spec)
        detail = {"results": own.where(F.col("load_date") == newest).orderBy("check_order"),
                  "summary": self.latest_summary().where(F.col("table") == table),
                  "volume": report.metric_bands(metrics, table, "rows"), "scores": report.score_series(metrics, table),
                  "heatmap": report.heatmap(checks, table),
                  "profile": profile(rows.where(F.col("load_date") == rows.agg(F.max("load_date")).scalar()), spec)}
        for r in self.catalog.rules_for(table):
            if r.type == "outlier":
                detail[f"outlier:{r.id}"] = report.metric_bands(metrics, table, f"rule:{r.id}")
        return detail

    def profile_between(self, table: str, first: date | None = None, last: date | None = None, *by: str) -> DataFrame:
        """Profile of a table's loads from `first` to `last` together, or one per value of `by`, from their sketches: no row is read."""
        return merged_profile(self.store.read("profiles", first, last).where(F.col("table") == table), *by)

    def metrics_text(self) -> DataFrame:
        """Gauges of the newest day, one `line` each."""
        return report.metrics_export(self.kpis(), self.latest_summary())
