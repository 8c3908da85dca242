"""Availability, structure, status, missing loads, overdue sources, scores and the whole validation."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import functions as F

from loadwatch.model import Catalog, Field, TableSpec, specs_frame
from loadwatch.operators.evaluate import evaluate_rules
from loadwatch.operators.monitors import availability, due_loads, missing_loads, overdue_source, structure, table_status
from loadwatch.operators.score import global_scores, table_scores
from loadwatch_queries.common import loads_of, rules_of, table
from loadwatch_queries.rules import LINEITEM_CHECKS, LINEITEM_RULES
from loadwatch_queries.state import TYPES, deliveries, state, with_state

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _priority_specs(spark):
    """Each order priority is a monitored table, expected an hour after the previous one."""
    return specs_frame(spark, Catalog(tuple(TableSpec(p, (Field("o_orderkey", "integer"),), expected_at=300 + 60 * i)
                                            for i, p in enumerate(PRIORITIES))))


_PRIORITY = "(VALUES " + ", ".join(f"('{p}', {300 + 60 * i})" for i, p in enumerate(PRIORITIES)) + ") s(tbl, expected_at)"


def _order_arrivals(spark, sf, now: int):
    """A priority arrives at the minute its dearest order of the day says; days without an order have not arrived."""
    orders = table(spark, sf, "orders").withColumn("load_date", F.col("o_orderdate").cast("date"))
    seen = orders.groupBy("load_date", F.col("o_orderpriority").alias("table")).agg(
        (F.floor(F.max("o_totalprice") / 1000) + 200).cast("int").alias("arrived_minute"))
    grid = orders.select("load_date").distinct().select("load_date", F.explode(F.array(*[F.lit(p) for p in PRIORITIES])).alias("table"))
    return grid.join(seen, ["load_date", "table"], "left").withColumn("now_minute", F.lit(now))


def _arrivals_sql(now: int) -> str:
    return f"""(SELECT days.d AS load_date, s.tbl, s.expected_at, x.arrived, {now} AS now_minute
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) days CROSS JOIN {_PRIORITY}
        LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS tbl, CAST(floor(max(o_totalprice) / 1000) + 200 AS INTEGER) AS arrived
                   FROM orders GROUP BY ALL) x ON x.d = days.d AND x.tbl = s.tbl)"""


@query(f"""SELECT load_date, tbl AS "table", CASE WHEN arrived IS NULL THEN 'fail' WHEN arrived - expected_at > 60 THEN 'warn' ELSE 'ok' END AS status,
    CAST(CASE WHEN arrived IS NULL THEN now_minute - expected_at ELSE greatest(arrived - expected_at, 0) END AS DOUBLE) AS value,
    'by ' || format('{{:02d}}:{{:02d}}', (expected_at + 60) // 60, (expected_at + 60) % 60) AS threshold,
    concat_ws('; ', 'arrived: ' || format('{{:02d}}:{{:02d}}', arrived // 60, arrived % 60), 'due: ' || format('{{:02d}}:{{:02d}}', expected_at // 60, expected_at % 60),
      CASE WHEN coalesce(arrived, now_minute) > expected_at THEN 'minutes after due: ' || (coalesce(arrived, now_minute) - expected_at) END) AS message
    FROM {_arrivals_sql(840)}""")
def availability_checks(spark, sf):
    checks = availability(_order_arrivals(spark, sf, 840), _priority_specs(spark))
    return checks.select("load_date", "table", "status", "value", "threshold", "message")


@query(f"""SELECT load_date, tbl AS "table", CASE WHEN date_diff('day', load_date, CAST(load_date + CAST(arrived % 4 AS INTEGER) AS DATE)) > 1 THEN 'ok'
      WHEN arrived - expected_at > 60 THEN 'warn' ELSE 'ok' END AS status,
    CAST(CASE WHEN arrived % 4 > 1 THEN 0 ELSE greatest(arrived - expected_at, 0) END AS DOUBLE) AS value
    FROM {_arrivals_sql(840)} WHERE arrived IS NOT NULL""")
def backfilled_dates(spark, sf):
    """Dates published two or three days later are not judged by their hour."""
    arrived = _order_arrivals(spark, sf, 840).where("arrived_minute is not null") \
        .withColumn("published", F.date_add("load_date", F.col("arrived_minute") % 4).cast("timestamp"))
    return availability(arrived, _priority_specs(spark)).select("load_date", "table", "status", "value")


@query(f"""SELECT load_date, tbl AS "table", CASE WHEN arrived IS NOT NULL THEN 'ok' WHEN now_minute - expected_at >= 60 THEN 'missing'
    WHEN now_minute - expected_at >= 0 THEN 'delayed' ELSE 'waiting' END AS status FROM {_arrivals_sql(450)}""")
def status_at_half_past_seven(spark, sf):
    return table_status(_order_arrivals(spark, sf, 450), _priority_specs(spark)).select("load_date", "table", "status")


@query(f"SELECT load_date, tbl AS \"table\" FROM {_arrivals_sql(0)} WHERE arrived IS NULL")
def tables_without_load(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("load_date"), F.col("o_orderpriority").alias("table"))
    return missing_loads(_priority_specs(spark), orders, orders)


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS load_date, list_sort(list(DISTINCT o_orderpriority)) AS got FROM orders GROUP BY 1),
    c AS (SELECT load_date, list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], lambda x: NOT list_contains(got, x))) AS missing,
                 list_filter(got, lambda x: x = '5-LOW') AS extra FROM r)
    SELECT load_date, CASE WHEN len(missing) > 0 THEN 'fail' WHEN len(extra) > 0 THEN 'warn' ELSE 'ok' END AS status,
      CAST(len(missing) + len(extra) AS DOUBLE) AS value,
      concat_ws('; ', 'agreed: 4', CASE WHEN len(missing) > 0 THEN 'absent: ' || array_to_string(missing, ', ') END,
        CASE WHEN len(extra) > 0 THEN 'not agreed: ' || array_to_string(extra, ', ') END) AS message FROM c""")
def structure_checks(spark, sf):
    """A daily pivot of orders: one column per priority seen that day, four of them agreed."""
    spec = TableSpec("pivot", tuple(Field(p, "integer") for p in PRIORITIES[:4]))
    received = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("load_date")) \
        .agg(F.collect_set("o_orderpriority").alias("columns")).withColumn("table", F.lit("pivot"))
    return structure(received, specs_frame(spark, Catalog((spec,)))).select("load_date", "status", "value", "message")


@query(f"""SELECT CAST(max(o_orderdate) AS DATE) + 1 AS load_date, s.tbl AS "table", 'fail' AS status,
    'source: Orders; newest publication: ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M') || '; due: '
      || format('{{:02d}}:{{:02d}}', any_value(s.expected_at) // 60, any_value(s.expected_at) % 60) AS message
    FROM orders CROSS JOIN {_PRIORITY} WHERE 500 >= s.expected_at + 60 GROUP BY s.tbl""")
def overdue_tables(spark, sf):
    """The day after the last order, at 08:20: the tables whose hour and grace have passed fail."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderdate")).first()[0]
    as_of = datetime.combine(last.date(), time(8, 20)) + (datetime(2000, 1, 2) - datetime(2000, 1, 1))
    published = orders.select(F.col("o_orderdate").cast("timestamp").alias("published"))
    return overdue_source(published, _priority_specs(spark), as_of, "Orders").select("load_date", "table", "status", "message")


@query("""SELECT CAST(ts AS DATE) AS load_date, event_type AS "table" FROM events WHERE event_type IN ('view', 'click')
    GROUP BY ALL UNION SELECT max(CAST(ts AS DATE)), event_type FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 2""")
def snapshot_only_newest(spark, sf):
    """Incremental tables are due every day, snapshots on the newest one."""
    specs = specs_frame(spark, Catalog(tuple(TableSpec(t, (Field("event_id", "integer"),),
                                                       load_type="incremental" if t in ("view", "click") else "snapshot") for t in TYPES)))
    loads = deliveries(spark, sf).where("arrived_minute is not null").select("load_date", "table")
    return due_loads(loads, specs)


# ------------------------------------------------------------------ scores
_WEIGHTED = f"""(SELECT load_date, CASE check_id WHEN 'L4' THEN 4 WHEN 'L7' THEN 4 WHEN 'L1' THEN 3 WHEN 'L2' THEN 3 WHEN 'L6' THEN 3
                 WHEN 'L3' THEN 2 ELSE 1 END AS w, status FROM ({LINEITEM_CHECKS}))"""


@query(f"""SELECT load_date, 'lineitem' AS "table", round_even(100.0::DOUBLE * sum(w * CASE status WHEN 'ok' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.5 ELSE 0 END) / sum(w), 1) AS score
    FROM {_WEIGHTED} GROUP BY 1""")
def lineitem_scores(spark, sf):
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem", "l_shipdate")
    return table_scores(evaluate_rules(df, spec, rules_of(spec, *LINEITEM_RULES)))


# -------------------------------------------------------- whole validation
@query(with_state("""SELECT load_date, tbl AS "table", check_id, check_order, name, kind, severity, rule_type, status, value, message,
    failing_rows, total_rows FROM checks"""))
def validated_history(spark, sf):
    """Every monitor and rule of five tables over all their loads."""
    return state(spark, sf).checks.select("load_date", "table", "check_id", "check_order", "name", "kind", "severity", "rule_type",
                                          "status", "value", "message", "failing_rows", "total_rows")


@query(with_state('SELECT load_date, tbl AS "table", score FROM scores'))
def history_scores(spark, sf):
    return state(spark, sf).validation.scores


@query(with_state("SELECT load_date, round(avg(score), 6) AS score FROM scores GROUP BY 1"))
def history_global_score(spark, sf):
    return global_scores(state(spark, sf).validation.scores).withColumn("score", F.round("score", 6))


@query(with_state("""SELECT a.d AS load_date, a.tbl AS "table", CASE WHEN arrived IS NULL THEN 'missing' WHEN bool_or(status = 'fail') THEN 'fail'
    WHEN bool_or(status IN ('warn', 'error')) THEN 'warn' ELSE 'ok' END AS status FROM a JOIN checks c ON c.tbl = a.tbl AND c.load_date = a.d
    GROUP BY a.d, a.tbl, arrived"""))
def history_status(spark, sf):
    s = state(spark, sf)
    return table_status(s.arrivals, s.specs, s.checks).select("load_date", "table", "status")
