"""One validated history the reading queries share: each event type is a table monitored every day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwatch.functions.scalars import minute_of_day
from loadwatch.model import Catalog, Field, TableSpec, specs_frame
from loadwatch.plans.validate import Validation, validate
from loadwatch.session import stage
from loadwatch_queries.common import band_sql, rules_of, table

TYPES = ("click", "error", "purchase", "signup", "view")
LAST_MINUTE = 1439
COLUMNS = (Field("event_id", "integer"), Field("ts", "date", spark_type="timestamp_ntz"), Field("user_id", "integer"),
           Field("value", "decimal"), Field("k", "integer"))


def catalog() -> Catalog:
    specs = tuple(TableSpec(t, COLUMNS, title=f"Events: {t}", owner=f"{t} team", owner_email=f"{t}@example.com", expected_at=0,
                            load_type="snapshot", consumers=("Dashboard", "Risk")) for t in TYPES)
    rules = [r for s in specs for r in rules_of(
        s, ("R001", "range", "high", {"column": "value", "max": 250, "max_pct": 2}),
        ("R002", "unique", "critical", {"columns": ["user_id", "k"]}),
        ("R003", "compare", "medium", {"column": "k", "operator": "<=", "other_column": "user_id", "max_pct": 45}),
        ("R004", "sql", "low", {"condition": "value < 0.1"}),
        ("R005", "outlier", "medium", {"column": "k", "aggregate": "sum", "z": 2, "same_weekday": False}))]
    return Catalog(specs, tuple(rules))


def events_with_key(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_type", "event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("ts").cast("date").alias("load_date"))


def deliveries(spark, sf) -> DataFrame:
    """What arrived of each table on each day: first minute, rows and the largest values seen."""
    events = events_with_key(spark, sf)
    seen = events.groupBy("load_date", F.col("event_type").alias("table")).agg(
        minute_of_day(F.min("ts")).alias("arrived_minute"), F.count(F.lit(1)).alias("row_count"),
        F.max("value").alias("top_value"), F.max("k").alias("top_k"))
    tables = F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("table")
    grid = events.select("load_date").distinct().select("load_date", tables)
    return grid.join(seen, ["load_date", "table"], "left").withColumn("now_minute", F.lit(LAST_MINUTE))


def received_columns(d: DataFrame) -> DataFrame:
    """Columns of each delivery: without `k` on days that never reach its top values, with an extra one on extreme days."""
    base = [F.lit(c.name) for c in COLUMNS if c.name != "k"]
    names = F.array_compact(F.array(*base, F.when(F.col("top_k") >= 96, "k"), F.when(F.col("top_value") > 300, "overflow")))
    return d.where("arrived_minute is not null").select("load_date", "table", names.alias("columns"))


@dataclass(frozen=True)
class State:
    catalog: Catalog
    specs: DataFrame
    arrivals: DataFrame
    loads: DataFrame
    validation: Validation

    @property
    def checks(self) -> DataFrame:
        return self.validation.checks


def state(spark, sf) -> State:
    cat = catalog()
    d = stage(deliveries(spark, sf), "deliveries")
    arrivals = d.select("load_date", "table", "arrived_minute", "now_minute")
    events = events_with_key(spark, sf)
    tables = {t: events.where(F.col("event_type") == t).drop("event_type") for t in TYPES}
    return State(cat, specs_frame(spark, cat), arrivals, d.select("load_date", "table", "row_count"),
                 validate(cat, tables, arrivals, received_columns(d)))


# --------------------------------------------------------------------- SQL
def _hhmm(m: str) -> str:
    return f"format('{{:02d}}:{{:02d}}', CAST({m} AS INTEGER) // 60, CAST({m} AS INTEGER) % 60)"


def _th(x: str) -> str:
    return f"replace(format('{{:,.0f}}', CAST({x} AS DOUBLE)), ',', '.')"


def _loc(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) OR abs({x}) >= 1000 THEN {_th(x)} ELSE translate(format('{{:,.2f}}', {x}), ',.', '.,') END"


_TABS = ", ".join(f"('{t}', {i})" for i, t in enumerate(TYPES))
_SERIES = """SELECT tbl || '/rows' AS key, d, CAST(n AS DOUBLE) AS v, 3.5::DOUBLE AS z, false AS wk, true AS vol FROM g
             UNION ALL SELECT tbl || '/R005', d, CAST(sk AS DOUBLE), 2::DOUBLE, false, false FROM g"""


def _row_rule(check: str, order: int, name: str, severity: str, kind: str, bad: str, tolerance: int) -> str:
    pct = f"(100.0::DOUBLE * {bad} / n)"
    return f"""SELECT d, tbl, '{check}', {order}, '{name}', 'rule', '{severity}', '{kind}',
        CASE WHEN {bad} > 0 AND {pct} > {tolerance} THEN 'fail' ELSE 'ok' END, round_even({pct}, 3),
        CASE WHEN {bad} > 0 THEN {_th(bad)} || ' of ' || {_th('n')} || ' rows fail (' || format('{{:.2f}}', round_even({pct}, 2)) || '%)'
             ELSE 'Every row complies' END, {bad}, n FROM a WHERE arrived IS NOT NULL"""


STATE = f"""
    e AS (SELECT event_type AS tbl, CAST(ts AS DATE) AS d, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    tabs(tbl, ord) AS (VALUES {_TABS}),
    g AS (SELECT tbl, d, count(*) AS n, min(ts) AS first_ts, max(value) AS mv, max(k) AS mk, CAST(sum(k) AS BIGINT) AS sk,
                 count(*) FILTER (WHERE value > 250) AS b1, count(*) FILTER (WHERE k > user_id) AS b3,
                 count(*) FILTER (WHERE value < 0.1) AS b4 FROM e GROUP BY ALL),
    u AS (SELECT tbl, d, CAST(sum(c - 1) AS BIGINT) AS b2, count(*) FILTER (WHERE c > 1) AS gr
          FROM (SELECT tbl, d, user_id, k, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1, 2),
    a AS (SELECT tabs.tbl, ord, days.d, hour(first_ts) * 60 + minute(first_ts) AS arrived, {LAST_MINUTE} AS now_minute, n, mv, mk, b1, b2, gr, b3, b4
          FROM tabs CROSS JOIN (SELECT DISTINCT d FROM e) days LEFT JOIN g USING (tbl, d) LEFT JOIN u USING (tbl, d)),
    {band_sql(_SERIES)},
    vb AS (SELECT split_part(key, '/', 1) AS tbl, * EXCLUDE (key) FROM bands WHERE vol),
    ob AS (SELECT split_part(key, '/', 1) AS tbl, * EXCLUDE (key) FROM bands WHERE NOT vol),
    checks(load_date, tbl, check_id, check_order, name, kind, severity, rule_type, status, value, message, failing_rows, total_rows) AS (
      SELECT d, tbl, 'availability', 0, 'Availability of the daily table', 'monitor', 'critical', 'availability',
        CASE WHEN arrived IS NULL THEN 'fail' WHEN arrived > 60 THEN 'warn' ELSE 'ok' END, CAST(coalesce(arrived, now_minute) AS DOUBLE),
        concat_ws('; ', 'arrived: ' || {_hhmm('arrived')}, 'due: 00:00', CASE WHEN coalesce(arrived, now_minute) > 0 THEN 'minutes after due: ' || coalesce(arrived, now_minute) END),
        0, NULL FROM a
      UNION ALL SELECT d, tbl, 'volume', 1, 'Row volume', 'monitor', 'high', CASE WHEN ok THEN 'volume' WHEN v < center THEN 'volume_low' ELSE 'volume_high' END,
        CASE WHEN ok THEN 'ok' ELSE 'fail' END, v,
        concat_ws('; ', 'rows: ' || {_th('v')}, 'band: ' || {_th('lo')} || ' to ' || {_th('hi')}, 'usual: ' || {_th('center')},
          CASE WHEN NOT ok AND center >= 1 THEN 'change: ' || format('{{:+.0f}}%', round_even(100 * (v - center) / center, 0)) END,
          CASE WHEN center IS NOT NULL THEN 'compared with: any day' END), 0, CAST(v AS BIGINT) FROM vb
      UNION ALL SELECT d, tbl, 'structure', 2, 'Column structure', 'monitor', 'high', 'structure',
        CASE WHEN mk < 96 THEN 'fail' WHEN mv > 300 THEN 'warn' ELSE 'ok' END, CAST((mk < 96)::INT + (mv > 300)::INT AS DOUBLE),
        concat_ws('; ', 'agreed: 5', CASE WHEN mk < 96 THEN 'absent: k' END, CASE WHEN mv > 300 THEN 'not agreed: overflow' END), 0, NULL FROM a WHERE arrived IS NOT NULL
      UNION ALL {_row_rule('R001', 3, 'range: value up to 250 in all but 2% of rows', 'high', 'range', 'b1', 2)}
      UNION ALL SELECT d, tbl, 'R002', 4, 'unique: user_id, k', 'rule', 'critical', 'unique', CASE WHEN b2 > 0 THEN 'fail' ELSE 'ok' END,
        CAST(b2 AS DOUBLE), CASE WHEN b2 > 0 THEN {_th('b2')} || ' repeated rows in ' || {_th('gr')} || ' values of user_id + k' ELSE 'No duplicates' END,
        b2, n FROM a WHERE arrived IS NOT NULL
      UNION ALL {_row_rule('R003', 5, 'compare: k <= user_id in all but 45% of rows', 'medium', 'compare', 'b3', 45)}
      UNION ALL {_row_rule('R004', 6, 'sql: value < 0.1', 'low', 'sql', 'b4', 0)}
      UNION ALL SELECT ob.d, ob.tbl, 'R005', 7, 'outlier: sum k within 2 spreads of the last 14 days', 'rule', 'medium', 'outlier',
        CASE WHEN ok THEN 'ok' ELSE 'fail' END, round_even(v, 4),
        concat_ws('; ', 'value: ' || {_loc('v')}, CASE WHEN center IS NOT NULL THEN 'band: ' || {_loc('lo')} || ' to ' || {_loc('hi')} END,
          CASE WHEN center IS NOT NULL THEN 'usual: ' || {_loc('center')} END, CASE WHEN NOT ok THEN 'spreads away: ' || format('{{:+.1f}}', round_even(score, 1)) END,
          'of: sum k'), 0, g.n
        FROM ob JOIN g USING (tbl, d)),
    weighed AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM checks),
    scores AS (SELECT load_date, tbl, CASE WHEN arrived IS NULL THEN 0 ELSE
                 round_even(100.0::DOUBLE * sum(w * CASE status WHEN 'ok' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.5 ELSE 0 END) / sum(w), 1) END AS score
               FROM weighed JOIN (SELECT d AS load_date, tbl, arrived FROM a) USING (load_date, tbl) GROUP BY load_date, tbl, arrived),
    seen AS (SELECT a.d, a.tbl, ord, coalesce(arrived, now_minute) AS minute,
                    (SELECT list({{'w': w, 'check_id': check_id, 'name': name, 'severity': severity, 'rule_type': rule_type, 'message': message}} ORDER BY w DESC, check_order)
                     FROM weighed c WHERE c.tbl = a.tbl AND c.load_date = a.d AND status = 'fail') AS fails FROM a),
    marked AS (SELECT *, fails IS NOT NULL AS fail,
                      fails IS NOT NULL AND NOT coalesce(lag(fails IS NOT NULL) OVER (PARTITION BY tbl ORDER BY d), false) AS opens FROM seen),
    islands AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY tbl ORDER BY d) AS island FROM marked),
    spans AS (SELECT tbl, ord, island, min(d) FILTER (WHERE opens) AS opened_date, min(minute) FILTER (WHERE opens) AS opened_minute,
                     arg_min(fails[1].name, d) FILTER (WHERE opens) AS title, max(fails[1].w) AS w, count(*) FILTER (WHERE fail) AS loads_failed,
                     arg_max(fails, d) FILTER (WHERE fail) AS evidence, min(d) FILTER (WHERE NOT fail) AS resolved_date,
                     arg_min(minute, d) FILTER (WHERE NOT fail) AS resolved_minute
              FROM islands WHERE island > 0 GROUP BY tbl, ord, island),
    incidents AS (SELECT *, 'INC-' || lpad(CAST(row_number() OVER (ORDER BY opened_date, opened_minute, ord) AS VARCHAR), 4, '0') AS incident_id,
                         CASE w WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
                         CASE WHEN resolved_date IS NULL THEN 'open' ELSE 'resolved' END AS status,
                         (date_diff('day', opened_date, coalesce(resolved_date, (SELECT max(d) FROM a))) * 1440
                          + coalesce(resolved_minute, {LAST_MINUTE}) - opened_minute) AS minutes_open FROM spans)"""


def with_state(sql: str) -> str:
    return f"WITH RECURSIVE {STATE} {sql}"
