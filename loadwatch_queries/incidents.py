"""Incidents, their story, analyst actions, recurrence and escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadwatch.functions.scalars import run_url
from loadwatch.model import FAIL
from loadwatch.operators import incidents as inc
from loadwatch.plans.escalation import CAUSES, escalation_reports
from loadwatch_queries.state import LAST_MINUTE, _hhmm, state, with_state

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


def _found(s, actions=None):
    return inc.incidents(s.validation.observations, actions, s.specs)


def _as_of(s):
    newest = s.arrivals.agg(F.max("load_date")).scalar()
    return newest, F.lit(LAST_MINUTE)


_EVIDENCE = "array_to_string(list_transform(evidence, lambda c: c.check_id), ' ')"


@query(with_state(f"""SELECT incident_id, tbl AS "table", severity, title, status, opened_date, CAST(opened_minute AS INTEGER) AS opened_minute,
    resolved_date, CAST(resolved_minute AS INTEGER) AS resolved_minute, CASE WHEN resolved_date IS NOT NULL THEN 'automatic' END AS resolution,
    loads_failed, {_EVIDENCE} AS evidence, minutes_open FROM incidents"""))
def all_incidents(spark, sf):
    s = state(spark, sf)
    evidence = F.concat_ws(" ", F.transform("checks", lambda c: c["check_id"]))
    return inc.minutes_open(_found(s), *_as_of(s)).select(
        "incident_id", "table", "severity", "title", "status", "opened_date", "opened_minute", "resolved_date", "resolved_minute",
        "resolution", "loads_failed", evidence.alias("evidence"), "minutes_open")


@query(with_state("""SELECT round_even(avg(minutes_open) FILTER (WHERE resolved_date IS NOT NULL) / 60, 1) AS mttr_hours,
    count(*) AS n_incidents, count(*) FILTER (WHERE resolved_date IS NULL) AS open_incidents FROM incidents"""))
def mean_time_to_resolve(spark, sf):
    s = state(spark, sf)
    return inc.minutes_open(_found(s), *_as_of(s)).agg(
        inc.mttr_hours().alias("mttr_hours"),
        F.count(F.lit(1)).alias("n_incidents"), F.count_if(F.col("resolved_date").isNull()).alias("open_incidents"))


_RECURRENCE = """(SELECT count(DISTINCT load_date) FROM checks c WHERE c.tbl = i.tbl AND c.status = 'fail'
                  AND c.load_date >= i.opened_date - 30 AND c.load_date < i.opened_date)"""


@query(with_state(f"SELECT incident_id, tbl AS \"table\", opened_date, {_RECURRENCE} AS recurrence_30d FROM incidents i"))
def recurrence(spark, sf):
    s = state(spark, sf)
    return inc.recurrence(_found(s), s.checks).select("incident_id", "table", "opened_date", "recurrence_30d")


_STORY = f"""story AS (
    SELECT i.incident_id, s.tbl, s.d, s.minute, 0 AS step, 'detected' AS kind, 'Detected: ' || fails[1].message AS text FROM islands s JOIN incidents i USING (tbl, island) WHERE opens
    UNION ALL SELECT i.incident_id, s.tbl, s.d, s.minute, 1, 'notified', 'Automatic notice to ' || s.tbl || ' team (' || s.tbl || '@example.com) because the severity is critical.'
      FROM islands s JOIN incidents i USING (tbl, island) WHERE opens AND fails[1].w = 4
    UNION ALL SELECT i.incident_id, s.tbl, s.d, s.minute, 2, 'persists', 'The load of ' || s.d || ' still fails: ' || fails[1].message
      FROM islands s JOIN incidents i USING (tbl, island) WHERE fail AND NOT opens
    UNION ALL SELECT incident_id, tbl, d, minute, 3, 'escalated', 'Severity rises to ' || fails[1].severity || '.' FROM (
      SELECT i.incident_id, s.*, max(fails[1].w) OVER (PARTITION BY s.tbl, s.island ORDER BY s.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM islands s JOIN incidents i USING (tbl, island) WHERE fail) WHERE fails[1].w > before
    UNION ALL SELECT incident_id, tbl, resolved_date, resolved_minute, 5, 'resolved', 'Resolved (automatic): '
        || CASE WHEN len(list_filter(evidence, lambda c: c.check_id = 'availability')) > 0
                THEN 'The table arrived at ' || {_hhmm('resolved_minute')} || ' and every check passes.'
                ELSE 'The load of ' || resolved_date || ' passes every check.' END FROM incidents WHERE resolved_date IS NOT NULL)"""


@query(with_state(f""", {_STORY} SELECT incident_id, tbl AS "table", CAST(row_number() OVER (PARTITION BY incident_id ORDER BY d, minute, step) AS INTEGER) AS position,
    d AS event_date, {_hhmm('minute')} AS event_time, kind, text FROM story"""))
def incident_timeline(spark, sf):
    s = state(spark, sf)
    return inc.timeline(s.validation.observations, s.specs)


def _actions(s):
    """Analysts escalate what failed critically that day and, on Mondays, resolve by hand; both at the end of the day."""
    critical = s.checks.where((F.col("status") == FAIL) & (F.col("severity") == "critical")).select("load_date", "table").distinct() \
        .withColumn("action", F.lit("escalate"))
    mondays = s.arrivals.where(F.weekday("load_date") == 0).select("load_date", "table").withColumn("action", F.lit("resolve"))
    return critical.unionByName(mondays).select(
        F.lit(0).cast("bigint").alias("seq"), "load_date", F.lit(LAST_MINUTE + 1).alias("minute"), "table", "action",
        F.lit("").alias("note"), F.lit("ana").alias("actor"))


WITH_ACTIONS = with_state(f""", ev AS (SELECT tbl, ord, d, minute, 0 AS turn, CASE WHEN fail THEN 'fail' ELSE 'pass' END AS event, fails FROM marked
      UNION ALL SELECT DISTINCT c.tbl, 0, load_date, {LAST_MINUTE + 1}, 1, 'escalate', NULL FROM checks c WHERE status = 'fail' AND severity = 'critical'
      UNION ALL SELECT tbl, ord, d, {LAST_MINUTE + 1}, 2, 'resolve', NULL FROM a WHERE isodow(d) = 1),
    p AS (SELECT *, last_value(CASE WHEN event <> 'escalate' THEN event END IGNORE NULLS) OVER (PARTITION BY tbl ORDER BY d, minute, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev),
    o AS (SELECT *, event = 'fail' AND coalesce(prev <> 'fail', true) AS opens2 FROM p),
    i2 AS (SELECT *, sum(CAST(opens2 AS INT)) OVER (PARTITION BY tbl ORDER BY d, minute, turn) AS isl FROM o),
    c2 AS (SELECT *, coalesce(bool_or(event IN ('pass', 'resolve')) OVER (PARTITION BY tbl, isl ORDER BY d, minute, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM i2 WHERE isl > 0)
    SELECT tbl AS "table", min(d) FILTER (WHERE opens2) AS opened_date,
      CASE WHEN bool_or(event IN ('pass', 'resolve')) THEN 'resolved' WHEN bool_or(event = 'escalate') THEN 'escalated' ELSE 'open' END AS status,
      max(CASE event WHEN 'resolve' THEN 'manual' ELSE 'automatic' END) FILTER (WHERE event IN ('pass', 'resolve') AND NOT closed) AS resolution,
      max(d) FILTER (WHERE event IN ('pass', 'resolve') AND NOT closed) AS resolved_date, count(*) FILTER (WHERE event = 'fail') AS loads_failed
    FROM c2 GROUP BY tbl, isl""")


@query(WITH_ACTIONS)
def incidents_with_actions(spark, sf):
    """A manual resolution splits an incident; an escalation does not."""
    s = state(spark, sf)
    return _found(s, _actions(s)).select("table", "opened_date", "status", "resolution", "resolved_date", "loads_failed")


@query(with_state("""SELECT incident_id, status, opened_date FROM incidents
    ORDER BY CASE WHEN resolved_date IS NULL THEN 0 ELSE 1 END, coalesce(resolved_date, opened_date) DESC,
             coalesce(resolved_minute, opened_minute) DESC, incident_id LIMIT 40"""))
def incident_report(spark, sf):
    """The list people see: open incidents first, at most 40."""
    return inc.incident_list(_found(state(spark, sf))).select("incident_id", "status", "opened_date")


@query(with_state("SELECT incident_id, opened_date FROM incidents WHERE resolved_date IS NULL OR resolved_date >= (SELECT max(d) FROM a) - 10"))
def incidents_kept(spark, sf):
    """Incidents open or resolved within ten days of the newest load."""
    s = state(spark, sf)
    return inc.keep_recent(_found(s), _as_of(s)[0], 10).select("incident_id", "opened_date")


@query(with_state(f"""SELECT incident_id, 'run ' || max_run AS run_id, max_run || 'T12:00:00' AS published_at, 'https://runs.example/' || 'run%20' || max_run AS run_url
    FROM (SELECT i.*, (SELECT CAST(max(d) AS VARCHAR) FROM islands s WHERE s.tbl = i.tbl AND s.island = i.island AND s.fail) AS max_run FROM incidents i)"""))
def incident_runs(spark, sf):
    """Each incident with the publication that brought its last failing load: here every day is one run."""
    s = state(spark, sf)
    run = F.concat(F.lit("run "), F.col("load_date").cast("string"))
    found = inc.incidents(s.validation.observations.withColumn("run_id", run), None, s.specs)
    at = F.concat(F.col("load_date").cast("string"), F.lit("T12:00:00"))
    log = s.arrivals.select(run.alias("run_id"), at.alias("published_at"), run_url("https://runs.example/{run_id}", run).alias("run_url")).distinct()
    return inc.with_runs(found, log).select("incident_id", "run_id", "published_at", "run_url")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CASE = "CASE " + " ".join(f"WHEN {{c}}.rule_type = '{k}' THEN {{{k}}}" for k in CAUSES) + " END"


def _lookup(c: str, which: int) -> str:
    return _CASE.format(c=c, **{k: _quote(v[which]) for k, v in CAUSES.items()})


@query(with_state(f"""SELECT incident_id, tbl AS "table", tbl || '@example.com' AS recipient,
    '[' || severity || '] ' || tbl || ': ' || title || ' (' || opened_date || ')' AS subject, {_lookup('evidence[1]', 0)} AS cause,
    array_to_string(list_concat([{_lookup('evidence[1]', 1)}], list_filter(list_transform(evidence[2:], lambda c: {_lookup('c', 1)}),
        lambda x: x <> {_lookup('evidence[1]', 1)})), chr(10)) AS actions,
    'To: ' || tbl || ' team' || chr(10) || 'Table: ' || tbl || ' - Events: ' || tbl || chr(10) || 'Load: ' || opened_date || ', seen at ' || {_hhmm('opened_minute')}
      || chr(10) || 'Severity: ' || severity || chr(10) || 'Who depends on it: Dashboard, Risk'
      || CASE WHEN r > 0 THEN chr(10) || 'It is the ' || (r + 1) || CASE WHEN (r + 1) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN (r + 1) % 10 = 1 THEN 'st'
              WHEN (r + 1) % 10 = 2 THEN 'nd' WHEN (r + 1) % 10 = 3 THEN 'rd' ELSE 'th' END || ' incident of this table within 30 days.' ELSE '' END
      || chr(10) || chr(10) || 'Please do this' || chr(10) || {_lookup('evidence[1]', 1)} || chr(10) || chr(10) || 'Why we write' || chr(10)
      || array_to_string(list_transform(evidence, lambda c: '* ' || c.name || ' -> ' || c.message), chr(10)) || chr(10) || chr(10)
      || 'What may be behind it' || chr(10) || {_lookup('evidence[1]', 0)} || chr(10) || chr(10)
      || 'Nothing has to be reported back: a later load without failing checks ends the incident.' AS body
    FROM (SELECT *, {_RECURRENCE} AS r FROM incidents i)"""))
def escalation_messages(spark, sf):
    s = state(spark, sf)
    return escalation_reports(inc.recurrence(_found(s), s.checks), s.specs)
