"""Incidents as islands of failing observations of a table.

An observation is one evaluation of a table: (seq, load_date, minute, table, run_id, checks), where `seq` is the
order of processing (0 in a full replay) and `checks` holds its failing checks, the most severe first. A table
that was missing and then arrived gives two observations on the same day.

The windows are partitioned by table over observations, a few rows per table and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwatch.functions.scalars import hhmm
from loadwatch.model import FAIL, SEVERITY_WEIGHT, severity_weight

OBSERVATION_SCHEMA = (
    "seq bigint, load_date date, minute int, table string, run_id string, "
    "checks array<struct<rank:int,check_order:int,check_id:string,name:string,severity:string,weight:int,"
    "rule_type:string,message:string>>")
ACTION_SCHEMA = "seq bigint, load_date date, minute int, table string, action string, note string, actor string"
#: Incidents that ended long ago, kept as rows so that their observations can go: `cut_*` is the event that ended them.
CLOSED_SCHEMA = (
    "table string, island bigint, opened_seq bigint, severity string, title string, status string, opened_date date, opened_minute int, "
    "resolved_date date, resolved_minute int, resolution string, loads_failed bigint, run_id string, "
    + OBSERVATION_SCHEMA[OBSERVATION_SCHEMA.index("checks array"):] + ", cut_seq bigint, cut_date date, cut_minute int, cut_turn int")
INCIDENT_COLUMNS = ["incident_id", "table", "severity", "title", "status", "opened_date", "opened_minute",
                    "resolved_date", "resolved_minute", "resolution", "loads_failed", "run_id", "checks"]


def observations(checks: DataFrame, minutes: DataFrame) -> DataFrame:
    """One observation per (load_date, table) from its check results.

    `minutes` has load_date, table, minute and optionally seq and run_id of the evaluation.
    """
    weight = severity_weight(F.col("severity"))
    found = F.struct((-weight).alias("rank"), "check_order", "check_id", "name", "severity", weight.alias("weight"),
                     "rule_type", "message")
    failing = checks.groupBy("load_date", "table").agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == FAIL, found))).alias("checks"))
    m = minutes
    if "seq" not in m.columns:
        m = m.withColumn("seq", F.lit(0).cast("bigint"))
    if "run_id" not in m.columns:
        m = m.withColumn("run_id", F.lit(None).cast("string"))
    return failing.join(m, ["load_date", "table"]).select("seq", "load_date", "minute", "table", "run_id", "checks")


def _severity_of(weight: Column) -> Column:
    out = None
    for name, w in SEVERITY_WEIGHT.items():
        out = F.when(weight == w, name) if out is None else out.when(weight == w, name)
    return out


def _stream(obs: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Observations and analyst actions of each table in one order, numbered by island."""
    none = F.lit(None).cast("string")
    events = obs.select("seq", "load_date", "minute", "table", "run_id", "checks",
                        F.when(F.size("checks") > 0, "fail").otherwise("pass").alias("event"),
                        none.alias("note"), none.alias("actor"), F.lit(0).alias("turn"))
    if actions is not None:
        events = events.unionByName(actions.select(
            "seq", "load_date", "minute", "table", none.alias("run_id"), F.col("action").alias("event"), "note", "actor",
            F.lit(1).alias("turn")), allowMissingColumns=True)
    by_table = Window.partitionBy("table").orderBy("seq", "load_date", "minute", "turn")
    before = by_table.rowsBetween(Window.unboundedPreceding, -1)
    # An escalation neither opens nor closes: it is transparent to the islands.
    marker = F.when(F.col("event") != "escalate", F.col("event"))
    events = events.withColumn("previous", F.last(marker, ignorenulls=True).over(before))
    opens = (F.col("event") == "fail") & ~F.coalesce(F.col("previous") == "fail", F.lit(False))
    events = events.withColumn("opens", opens.cast("int"))
    return events.withColumn("island", F.sum("opens").over(by_table)).where(F.col("island") > 0) \
        .withColumn("at", F.struct("seq", "load_date", "minute", "turn"))


def _facts(events: DataFrame) -> DataFrame:
    """Per event of an island: the first main check, whether it persists, severity before and after."""
    island = Window.partitionBy("table", "island").orderBy("at")
    before = island.rowsBetween(Window.unboundedPreceding, -1)
    fail = F.col("event") == "fail"
    main = F.get("checks", 0)
    e = events.withColumn("main", F.when(fail, main))
    e = e.withColumn("last_day", F.last(F.when(fail, F.col("load_date")), ignorenulls=True).over(before))
    e = e.withColumn("weight_before", F.max(F.col("main.weight")).over(before))
    e = e.withColumn("closed_before", F.coalesce(F.max(F.col("event").isin("pass", "resolve")).over(before), F.lit(False)))
    e = e.withColumn("persists", fail & (F.col("load_date") != F.col("last_day")))
    e = e.withColumn("raises", fail & (F.col("main.weight") > F.col("weight_before")))
    return e.withColumn("closes", F.col("event").isin("pass", "resolve") & ~F.col("closed_before"))


def incidents(obs: DataFrame, actions: DataFrame | None = None, table_order: DataFrame | None = None,
              closed: DataFrame | None = None) -> DataFrame:
    """One row per incident: opened, severity, evidence, loads failed, resolution. `closed`: incidents kept as rows, whose
    events `obs` and `actions` no longer hold (`after_closed`)."""
    found = _collapse(_facts(_stream(obs, actions)))
    return number_incidents(_with_closed(found, closed), table_order).select(*INCIDENT_COLUMNS)


def _with_closed(found: DataFrame, closed: DataFrame | None) -> DataFrame:
    """Kept incidents beside the others; their islands are numbered below 0, away from those that are counted anew."""
    if closed is None:
        return found
    return found.unionByName(closed.withColumn("island", F.col("island") - F.lit(1 << 40)).select(found.columns))


def settled(obs: DataFrame, actions: DataFrame | None, before: Column) -> DataFrame:
    """The incidents of each table up to the first one that is open or ended on `before` or later, as `CLOSED_SCHEMA` rows."""
    events = _facts(_stream(obs, actions))
    ends = events.where("closes").groupBy("table", "island").agg(F.min("at").alias("cut"))
    done = F.coalesce(F.col("resolved_date") < before, F.lit(False)).cast("int")
    so_far = Window.partitionBy("table").orderBy("island").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = _collapse(events).withColumn("done", F.min(done).over(so_far)).where("done = 1").join(ends, ["table", "island"])
    cut = [F.col(f"cut.{a}").alias(f"cut_{b}") for a, b in (("seq", "seq"), ("load_date", "date"), ("minute", "minute"), ("turn", "turn"))]
    names = [c.split(" ")[0].strip() for c in CLOSED_SCHEMA.split(", ") if not c.startswith("cut_")]
    return old.select(*[n for n in names if n in old.columns], *cut)


def after_closed(events: DataFrame, closed: DataFrame, turn: int = 0) -> DataFrame:
    """Observations (`turn` 0) or actions (1) that come after everything `closed` has settled for their table."""
    moment = [F.col(a).alias(b) for a, b in (("cut_seq", "seq"), ("cut_date", "load_date"), ("cut_minute", "minute"), ("cut_turn", "turn"))]
    cuts = closed.groupBy("table").agg(F.max(F.struct(*moment)).alias("__cut"))
    at = F.struct("seq", "load_date", "minute", F.lit(turn).alias("turn"))
    return events.join(cuts, "table", "left").where(F.col("__cut").isNull() | (at > F.col("__cut"))).select(events.columns)


def still_needed(obs: DataFrame, actions: DataFrame | None) -> DataFrame:
    """The processing numbers (`seq`) of the events between the opening and the end of an incident."""
    return _facts(_stream(obs, actions)).where(~F.col("closed_before")).select("seq").distinct()


def _collapse(e: DataFrame) -> DataFrame:
    fail, closes = F.col("event") == "fail", F.col("closes")
    escalated = (F.col("event") == "escalate") & ~F.col("closed_before")
    counted = fail & ((F.col("opens") == 1) | F.col("persists"))
    moment = F.struct("load_date", "minute")
    found = e.groupBy("table", "island").agg(
        F.min(F.when(F.col("opens") == 1, moment)).alias("opened"),
        F.min_by("main.name", F.when(F.col("opens") == 1, F.col("at"))).alias("title"),
        F.max("main.weight").alias("weight"),
        F.count_if(counted).alias("loads_failed"),
        F.max_by("run_id", F.when(counted & F.col("run_id").isNotNull(), F.col("at"))).alias("run_id"),
        F.max_by("checks", F.when(fail, F.col("at"))).alias("checks"),
        F.bool_or(escalated).alias("escalated"),
        F.min(F.when(F.col("opens") == 1, F.col("seq"))).alias("opened_seq"),
        F.max(F.when(closes, moment)).alias("closed"),
        F.max(F.when(closes, F.when(F.col("event") == "resolve", "manual").otherwise("automatic"))).alias("resolution"))
    resolved = F.when(F.col("closed").isNotNull(), F.greatest("closed", "opened"))
    found = found.withColumn("resolved", resolved)
    status = F.when(F.col("resolved").isNotNull(), "resolved").when(F.col("escalated"), "escalated").otherwise("open")
    return found.select(
        "table", "island", "opened_seq", _severity_of(F.col("weight")).alias("severity"), "title", status.alias("status"),
        F.col("opened.load_date").alias("opened_date"), F.col("opened.minute").alias("opened_minute"),
        F.col("resolved.load_date").alias("resolved_date"), F.col("resolved.minute").alias("resolved_minute"),
        "resolution", F.col("loads_failed").cast("bigint").alias("loads_failed"), "run_id", "checks")


def number_incidents(found: DataFrame, table_order: DataFrame | None = None) -> DataFrame:
    """Ids `INC-0001` in opening order: numbered within each opening day, plus the incidents of earlier days."""
    if table_order is None:
        found = found.withColumn("table_order", F.lit(0))
    else:
        found = found.join(table_order.select("table", "table_order"), "table", "left")
    day = ["opened_seq", "opened_date"]
    within = Window.partitionBy(*day).orderBy("opened_minute", "table_order", "table", "island")
    per_day = found.groupBy(*day).agg(F.count(F.lit(1)).alias("n"))
    # one row per opening day
    earlier = Window.orderBy(*day).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = found.withColumn("position", F.row_number().over(within)).join(offsets, day)
    number = (F.col("offset") + F.col("position")).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.withColumn("incident_id", F.concat(F.lit("INC-"), padded))


def timeline(obs: DataFrame, specs: DataFrame, actions: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """The story of each incident: detected, notified, persists, escalated, resolved, in order. Incidents kept as rows
    (`closed`) have a number and no story."""
    events = _facts(_stream(obs, actions))
    found = number_incidents(_with_closed(_collapse(events), closed), specs)
    heads = found.where("island > 0").select("table", "island", "incident_id", F.struct(
        F.col("opened_date").alias("load_date"), F.col("opened_minute").alias("minute")).alias("opened"))
    e = events.join(specs.select("table", "owner", "owner_email"), "table")
    # What the closing observation is told depends on the evidence it clears.
    island = Window.partitionBy("table", "island").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("evidence", F.last(F.when(F.col("event") == "fail", F.col("checks")), ignorenulls=True).over(island))
    opens = F.col("opens") == 1
    to_owner = F.concat(F.col("owner"), F.lit(" ("), F.col("owner_email"), F.lit(")"))
    absent = F.exists("evidence", lambda c: c["check_id"] == "availability")
    automatic = F.when(absent, F.concat(F.lit("The table arrived at "), hhmm(F.col("minute")), F.lit(" and every check passes."))) \
        .otherwise(F.concat(F.lit("The load of "), F.col("load_date").cast("string"), F.lit(" passes every check.")))
    note = F.when(F.length("note") > 0, F.col("note")).otherwise(F.lit("No comment"))
    manual = F.concat(note, F.lit(" — "), F.coalesce("actor", F.lit("analyst")))
    closed = F.when(F.col("event") == "resolve", F.concat(F.lit("Resolved (manual): "), manual)) \
        .otherwise(F.concat(F.lit("Resolved (automatic): "), automatic))

    def entry(step: int, kind: str, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text")))

    entries = F.array(
        entry(0, "detected", opens, F.concat(F.lit("Detected: "), F.col("main.message"))),
        entry(1, "notified", opens & (F.col("main.severity") == "critical"),
              F.concat(F.lit("Automatic notice to "), to_owner, F.lit(" because the severity is critical."))),
        entry(2, "persists", F.col("persists"), F.concat(F.lit("The load of "), F.col("load_date").cast("string"),
                                                         F.lit(" still fails: "), F.col("main.message"))),
        entry(3, "escalated", F.col("raises"), F.concat(F.lit("Severity rises to "), F.col("main.severity"), F.lit("."))),
        entry(4, "escalated", F.col("event") == "escalate",
              F.concat(F.lit("Escalated by "), F.coalesce("actor", F.lit("analyst")), F.lit(" to "), to_owner, F.lit("."))),
        entry(5, "resolved", F.col("closes"), closed))
    told = e.select("table", "island", "at", F.struct("load_date", "minute").alias("moment"),
                    F.explode(entries).alias("entry")).where("entry is not null").join(heads, ["table", "island"])
    # A closing event never shows a moment before the opening.
    shown = F.when(F.col("entry.kind") == "resolved", F.greatest("moment", "opened")).otherwise(F.col("moment"))
    ordered = Window.partitionBy("incident_id").orderBy("at", "entry.step")
    return told.withColumn("shown", shown).withColumn("position", F.row_number().over(ordered)).select(
        "incident_id", "table", "position", F.col("shown.load_date").alias("event_date"),
        hhmm(F.col("shown.minute")).alias("event_time"), F.col("entry.kind").alias("kind"), F.col("entry.text").alias("text"))


def minutes_open(found: DataFrame, as_of_date: Column, as_of_minute: Column) -> DataFrame:
    """Incidents with the minutes they were, or still are, open."""
    day = F.coalesce("resolved_date", as_of_date)
    minute = F.coalesce("resolved_minute", as_of_minute)
    return found.withColumn("minutes_open", (F.datediff(day, "opened_date") * 1440 + minute - F.col("opened_minute")).cast("bigint"))


def incident_list(found: DataFrame, status: str | None = None, limit: int | None = 40) -> DataFrame:
    """Open incidents first, the latest opened first; then the resolved ones, the latest resolved first."""
    rows = found if status is None else found.where(F.col("status") == status)
    is_open = F.col("resolved_date").isNull()
    moment = F.when(is_open, F.struct("opened_date", "opened_minute")) \
        .otherwise(F.struct(F.col("resolved_date").alias("opened_date"), F.col("resolved_minute").alias("opened_minute")))
    rows = rows.orderBy(F.desc(is_open.cast("int")), F.desc(moment), "incident_id")
    return rows.limit(limit) if limit else rows


def keep_recent(found: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """Incidents that are open or were resolved within the last `days`."""
    return found.where(F.col("resolved_date").isNull() | (F.col("resolved_date") >= F.date_sub(as_of, days)))


def recurrence(found: DataFrame, checks: DataFrame, days: int = 30) -> DataFrame:
    """Distinct failing days of the table in the `days` before each incident opened."""
    failing = checks.where(F.col("status") == FAIL).select("table", "load_date").distinct()
    # Each failing day reaches the incidents of its table in that window through the days themselves: an equi-join.
    reach = found.select("incident_id", "table", "opened_date").withColumn(
        "load_date", F.explode(F.sequence(F.date_sub("opened_date", days), F.date_sub("opened_date", 1))))
    hits = reach.join(failing, ["table", "load_date"]).groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(hits, "incident_id", "left") \
        .withColumn("recurrence_30d", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


def with_runs(found: DataFrame, log: DataFrame) -> DataFrame:
    """Incidents with the publication of the run that brought their failing load, when it is known."""
    runs = log.groupBy("run_id").agg(F.max_by(F.struct("published_at", "run_url"), "published_at").alias("run"))
    return found.join(runs, "run_id", "left").withColumns({"published_at": F.col("run.published_at"), "run_url": F.col("run.run_url")}).drop("run")


def mttr_hours() -> Column:
    """Mean hours to resolve, for an aggregation over incidents with `minutes_open`."""
    return F.bround(F.avg(F.when(F.col("resolved_date").isNotNull(), F.col("minutes_open"))) / 60, 1)
