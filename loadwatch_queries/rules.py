"""Row rules, uniqueness, fused evaluation, examples, aggregates, profiles and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadwatch.model import OPERATORS
from loadwatch.operators.evaluate import (daily_stats, duplicate_examples, duplicate_groups, evaluate_rules,
                                          failing_examples, preview_rule)
from loadwatch.operators.profile import profile, segment_indicators, suggest_rules
from loadwatch.operators.sketches import load_sketches, merged_profile
from loadwatch.session import shared_dir
from loadwatch.sources.store import Store
from loadwatch.functions.scalars import evidence_number, grade, hhmm, locale_number, minute_of_day, run_url
from loadwatch_queries.common import SNAPSHOT, loads_of, row_check_sql, rules_of, shown, table

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


# -------------------------------------------------------------- row rules
def _documents(spark, sf):
    """Documents with their label, when they have one, and the first year their text mentions, or a blank."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "lang", "quality", F.concat(F.lit("  "), F.regexp_extract("text", "[0-9]{4}", 0)).alias("first_year"))


@query(row_check_sql("""(SELECT d.lang, l.quality, '  ' || regexp_extract(d.text, '[0-9]{4}') AS first_year
                         FROM documents d LEFT JOIN labels l USING (doc_id))""", SNAPSHOT, [
    ("N1", "quality IS NULL", 50), ("N2", "quality IS NULL", 95),
    ("N3", "first_year IS NULL OR trim(first_year) = ''", 0), ("N4", "lang IS NULL OR trim(lang) = ''", 0)]))
def not_null_tolerance(spark, sf):
    df, spec = loads_of(_documents(spark, sf), "documents")
    rules = rules_of(spec, ("N1", "not_null", "high", {"column": "quality", "max_pct": 50}),
                     ("N2", "not_null", "high", {"column": "quality", "max_pct": 95}),
                     ("N3", "not_null", "medium", {"column": "first_year"}),
                     ("N4", "not_null", "critical", {"column": "lang"}))
    return shown(evaluate_rules(df, spec, rules))


@query(row_check_sql("customer", SNAPSHOT, [
    ("G1", "c_acctbal < 0", 0), ("G2", "c_acctbal > 9000", 0), ("G3", "c_acctbal < 0 OR c_acctbal > 9000", 25),
    ("G4", "c_nationkey < 0 OR c_nationkey > 24", 0)]))
def range_rule(spark, sf):
    df, spec = loads_of(table(spark, sf, "customer"), "customer")
    rules = rules_of(spec, ("G1", "range", "high", {"column": "c_acctbal", "min": 0}),
                     ("G2", "range", "high", {"column": "c_acctbal", "max": "9000"}),
                     ("G3", "range", "low", {"column": "c_acctbal", "min": 0, "max": 9000, "max_pct": 25}),
                     ("G4", "range", "low", {"column": "c_nationkey", "min": 0, "max": 24}))
    return shown(evaluate_rules(df, spec, rules))


@query(row_check_sql("events", "CAST(ts AS DATE)", [
    ("V1", "event_type NOT IN ('click', 'view', 'purchase', 'signup')", 0),
    ("V2", "event_type NOT IN ('click', 'view', 'purchase', 'signup')", 20),
    ("V3", "user_id NOT IN (1, 2, 3, 40, 50)", 99)]))
def allowed_values(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    rules = rules_of(spec, ("V1", "allowed_values", "medium", {"column": "event_type", "values": "click, view,purchase ,signup"}),
                     ("V2", "allowed_values", "medium", {"column": "event_type", "max_pct": 20,
                                                         "values": ["click", "view", "purchase", "signup"]}),
                     ("V3", "allowed_values", "low", {"column": "user_id", "values": [1, "2", "3.0", 40, "50", "none"], "max_pct": 99}))
    return shown(evaluate_rules(df, spec, rules))


@query(row_check_sql("lineitem", "CAST(l_shipdate AS DATE)",
                     [(f"O{i}", f"NOT (l_tax {'<>' if op == '!=' else op} l_discount)", 50) for i, op in enumerate(OPERATORS)]))
def compare_columns(spark, sf):
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem", "l_shipdate")
    rules = rules_of(spec, *[(f"O{i}", "compare", "high", {"column": "l_tax", "operator": op, "other_column": "l_discount", "max_pct": 50})
                             for i, op in enumerate(OPERATORS)])
    return shown(evaluate_rules(df, spec, rules))


@query(row_check_sql("(SELECT *, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS settled_at FROM events)", "CAST(ts AS DATE)",
                     [("D1", "CAST(ts AS DATE) <> CAST(ts AS DATE)", 0),
                      ("D2", "CAST(settled_at AS DATE) <> CAST(ts AS DATE)", 0),
                      ("D3", "CAST(settled_at AS DATE) <> CAST(ts AS DATE)", 4)]))
def same_day(spark, sf):
    settled = F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(floor(value) as int), 0)")
    df, spec = loads_of(table(spark, sf, "events").withColumn("settled_at", settled), "events", "ts")
    rules = rules_of(spec, ("D1", "same_day", "critical", {"column": "ts"}), ("D2", "same_day", "critical", {"column": "settled_at"}),
                     ("D3", "same_day", "low", {"column": "settled_at", "max_pct": 4}))
    return shown(evaluate_rules(df, spec, rules))


_CONDITION = "o_orderstatus = 'F' AND (o_totalprice < 20000 OR o_totalprice > 480000)"


@query(row_check_sql("orders", "CAST(o_orderdate AS DATE)", [("Q1", _CONDITION, 0), ("Q2", "o_totalprice / 2 > 150000", 60)]))
def sql_rule(spark, sf):
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, ("Q1", "sql", "critical", {"condition": _CONDITION}),
                     ("Q2", "sql", "low", {"condition": "o_totalprice / 2 > 150000", "max_pct": 60}))
    return shown(evaluate_rules(df, spec, rules))


@query(row_check_sql("(SELECT o.*, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS owing FROM orders o)",
                     "CAST(o_orderdate AS DATE)", [("Q3", "owing", 10)]))
def sql_rule_subquery(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("monitored_customer")
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    condition = "o_custkey IN (SELECT c_custkey FROM monitored_customer WHERE c_acctbal < 0)"
    return shown(evaluate_rules(df, spec, rules_of(spec, ("Q3", "sql", "high", {"condition": condition, "max_pct": 10}))))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS load_date, count(*) AS n, count(*) FILTER (WHERE o_totalprice < 5000) AS bad
                     FROM orders GROUP BY 1)
    SELECT load_date, 'X1' AS check_id, 'error' AS status, CAST(NULL AS DOUBLE) AS value, 0 AS failing_rows, n AS total_rows FROM d
    UNION ALL SELECT load_date, 'X2', CASE WHEN bad > 0 THEN 'fail' ELSE 'ok' END, round_even(100.0::DOUBLE * bad / n, 3), bad, n FROM d""")
def isolated_error(spark, sf):
    """A rule that names an unknown column is an error on every load; the other one is evaluated."""
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, ("X1", "sql", "high", {"condition": "no_such_column > 1"}),
                     ("X2", "range", "high", {"column": "o_totalprice", "min": 5000}))
    return shown(evaluate_rules(df, spec, rules))


# -------------------------------------------------------------- uniqueness
def _unique_sql(source: str, day: str, keys: str, check: str) -> str:
    return f"""SELECT load_date, '{check}' AS check_id, CASE WHEN sum(c - 1) > 0 THEN 'fail' ELSE 'ok' END AS status,
        CAST(sum(c - 1) AS DOUBLE) AS value, CAST(sum(c - 1) AS BIGINT) AS failing_rows, CAST(sum(c) AS BIGINT) AS total_rows
        FROM (SELECT {day} AS load_date, {keys}, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY 1"""


@query(_unique_sql("lineitem", SNAPSHOT, "l_orderkey, l_linenumber", "U1") + " UNION ALL "
       + _unique_sql("lineitem", SNAPSHOT, "l_orderkey", "U2"))
def unique_snapshot(spark, sf):
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem")
    rules = rules_of(spec, ("U1", "unique", "critical", {"columns": ["l_orderkey", "l_linenumber"]}),
                     ("U2", "unique", "critical", {"columns": ["l_orderkey"]}))
    return shown(evaluate_rules(df, spec, rules))


@query(_unique_sql("lineitem", "CAST(l_shipdate AS DATE)", "l_orderkey", "U3"))
def unique_daily(spark, sf):
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem", "l_shipdate")
    return shown(evaluate_rules(df, spec, rules_of(spec, ("U3", "unique", "critical", {"columns": ["l_orderkey"]}))))


@query(_unique_sql("documents", SNAPSHOT, "text", "U4"))
def unique_text(spark, sf):
    df, spec = loads_of(table(spark, sf, "documents"), "documents")
    return shown(evaluate_rules(df, spec, rules_of(spec, ("U4", "unique", "high", {"columns": ["text"]}))))


@query(_unique_sql("(SELECT d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))", SNAPSHOT, "source, quality", "U5"))
def unique_with_nulls(spark, sf):
    """NULL keys group together: unlabelled documents of a source are one group."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("source", "quality")
    df, spec = loads_of(joined, "documents")
    return shown(evaluate_rules(df, spec, rules_of(spec, ("U5", "unique", "high", {"columns": ["source", "quality"]}))))


@query(f"SELECT {SNAPSHOT} AS load_date, l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_groups(spark, sf):
    df, _ = loads_of(table(spark, sf, "lineitem"), "lineitem")
    return duplicate_groups(df, ["l_orderkey", "l_linenumber"])


@query("""SELECT load_date, CAST(position AS INTEGER) AS position, user_id, event_type, times FROM (
    SELECT *, row_number() OVER (PARTITION BY load_date ORDER BY times DESC, user_id, event_type) AS position FROM (
      SELECT CAST(ts AS DATE) AS load_date, user_id, event_type, count(*) AS times FROM events GROUP BY ALL HAVING count(*) > 1))
    WHERE position <= 5""")
def most_repeated_groups(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    return duplicate_examples(df, spec, rules_of(spec, ("U6", "unique", "high", {"columns": ["user_id", "event_type"]}))[0])


# ------------------------------------------------------------ all together
LINEITEM_RULES = (
    ("L1", "range", "high", {"column": "l_quantity", "max": 49, "max_pct": 5}),
    ("L2", "compare", "high", {"column": "l_tax", "operator": "<=", "other_column": "l_discount", "max_pct": 45}),
    ("L3", "allowed_values", "medium", {"column": "l_returnflag", "values": ["A", "R"], "max_pct": 50}),
    ("L4", "unique", "critical", {"columns": ["l_orderkey"]}),
    ("L5", "sql", "low", {"condition": "l_extendedprice < 3000 AND l_quantity > 40"}),
    ("L6", "not_null", "high", {"column": "l_linestatus"}),
    ("L7", "same_day", "critical", {"column": "l_shipdate"}),
)
_ROW_CHECKS = row_check_sql("lineitem", "CAST(l_shipdate AS DATE)", [
    ("L1", "l_quantity > 49", 5), ("L2", "l_tax > l_discount", 45), ("L3", "l_returnflag NOT IN ('A', 'R')", 50),
    ("L5", "l_extendedprice < 3000 AND l_quantity > 40", 0), ("L6", "trim(l_linestatus) = ''", 0), ("L7", "l_shipdate IS NULL", 0)])
LINEITEM_CHECKS = f"""SELECT * FROM ({_ROW_CHECKS}) UNION ALL {_unique_sql('lineitem', 'CAST(l_shipdate AS DATE)', 'l_orderkey', 'L4')}"""


@query(LINEITEM_CHECKS)
def fused_checks(spark, sf):
    """Six row rules in one scan and one aggregation, and a uniqueness rule, over every load of lineitem."""
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem", "l_shipdate")
    return shown(evaluate_rules(df, spec, rules_of(spec, *LINEITEM_RULES)))


@query("""WITH bad AS (SELECT CAST(o_orderdate AS DATE) AS load_date, 'H1' AS check_id, * FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT CAST(o_orderdate AS DATE), 'H2', * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
    SELECT load_date, check_id, CAST(position AS INTEGER) AS position, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY load_date, check_id ORDER BY o_orderkey) AS position FROM bad) WHERE position <= 5""")
def bad_row_examples(spark, sf):
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, ("H1", "range", "high", {"column": "o_totalprice", "max": 400000}),
                     ("H2", "allowed_values", "low", {"column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]}))
    return failing_examples(df, spec, rules).select(
        "load_date", "check_id", "position", F.get_json_object("example", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
        F.get_json_object("example", "$.o_totalprice").cast("double").alias("o_totalprice"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS load_date, count(*) AS n, count(*) FILTER (WHERE value > 150) AS bad FROM events
                     WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1)
    SELECT load_date, CASE WHEN bad > 0 AND 100.0::DOUBLE * bad / n > 3 THEN 'fail' ELSE 'ok' END AS status, bad AS failing_rows, n AS total_rows,
           CAST(CASE WHEN bad > 5 THEN 5 ELSE bad END AS BIGINT) AS n_examples FROM d""")
def previewed_rule(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    p = preview_rule(df, spec, rules_of(spec, ("new", "range", "high", {"column": "value", "max": 150, "max_pct": 3}))[0])
    return spark.createDataFrame([(p["date"], p["status"], p["failing_rows"], p["total_rows"], len(p["examples"]))],
                                 "load_date date, status string, failing_rows bigint, total_rows bigint, n_examples bigint")


@query("""SELECT load_date, check_id, round(value, 4) AS value, n AS total_rows FROM (
    SELECT CAST(ts AS DATE) AS load_date, count(*) AS n, sum(value) AS "sum", avg(value) AS "avg", max(value) AS "max",
           min(value) AS "min", CAST(count(*) AS DOUBLE) AS "count", CAST(count(*) AS DOUBLE) AS "rows" FROM events GROUP BY 1)
    UNPIVOT (value FOR check_id IN ("sum", "avg", "max", "min", "count", "rows"))""")
def daily_aggregates(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    rules = rules_of(spec, *[(a, "outlier", "low", {"column": "value", "aggregate": a}) for a in ("sum", "avg", "max", "min", "count")])
    return daily_stats(df, spec, rules).select("load_date", "check_id", F.round("value", 4).alias("value"), "total_rows")


@query("""WITH cal AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS load_date FROM orders),
    u AS (SELECT CAST(o_orderdate AS DATE) AS load_date, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS bad,
                 sum(o_totalprice) AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1)
    SELECT load_date, check_id, value, failing_rows, total_rows FROM (
      SELECT load_date, 'rows' AS check_id, CAST(coalesce(n, 0) AS DOUBLE) AS value, 0 AS failing_rows, coalesce(n, 0) AS total_rows FROM cal LEFT JOIN u USING (load_date)
      UNION ALL SELECT load_date, 'E1', NULL, coalesce(bad, 0), coalesce(n, 0) FROM cal LEFT JOIN u USING (load_date)
      UNION ALL SELECT load_date, 'E2', round(coalesce(total, 0), 2), 0, coalesce(n, 0) FROM cal LEFT JOIN u USING (load_date))""")
def empty_loads(spark, sf):
    """Urgent filled orders per calendar day: delivered days without a row count 0, pass row rules and add up to 0."""
    orders = table(spark, sf, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    df, spec = loads_of(urgent, "urgent", "o_orderdate")
    day = F.col("o_orderdate").cast("date")
    days = orders.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("load_date"))
    rules = rules_of(spec, ("E1", "range", "high", {"column": "o_totalprice", "max": 300000}),
                     ("E2", "outlier", "high", {"column": "o_totalprice", "aggregate": "sum"}))
    return daily_stats(df, spec, rules, days).select("load_date", "check_id", F.round("value", 2).alias("value"), "failing_rows", "total_rows")


# ----------------------------------------------------------------- profile
def _profile_sql(name: str, columns: list[tuple[str, str]], day: str, distinct: bool = True) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        number = kind in ("integer", "decimal")
        parts.append(f"""SELECT {day} AS load_date, '{name}' AS "table", {i} AS position, '{c}' AS "column", '{kind}' AS type,
            round_even(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_pct,
            {f'count(DISTINCT {c}) AS distinct_values,' if distinct else ''}
            {f'CAST(min({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS min_value,
            {f'CAST(max({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS max_value,
            {f'round_even(avg({c}), 2)' if number else 'CAST(NULL AS DOUBLE)'} AS mean_value FROM {name} GROUP BY 1""")
    return " UNION ALL ".join(parts)


_EVENTS = [("event_id", "integer"), ("ts", "date"), ("user_id", "integer"), ("event_type", "text"), ("value", "decimal"), ("props", "text")]
_CUSTOMER = [("c_custkey", "integer"), ("c_name", "text"), ("c_nationkey", "integer"), ("c_acctbal", "decimal"), ("c_mktsegment", "text")]
_DOCUMENTS = [("doc_id", "integer"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "integer")]


@query(f"{_profile_sql('events', _EVENTS, 'CAST(ts AS DATE)')} UNION ALL {_profile_sql('customer', _CUSTOMER, SNAPSHOT)} "
       f"UNION ALL {_profile_sql('documents', _DOCUMENTS, SNAPSHOT)}")
def column_profile(spark, sf):
    """Null percentage, distinct values, minimum, maximum and mean of every column of every load."""
    out = None
    for name, column in (("events", "ts"), ("customer", ""), ("documents", "")):
        one = profile(*loads_of(table(spark, sf, name), name, column))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT *, true AS estimate_close FROM ({_profile_sql("events", _EVENTS, "CAST(ts AS DATE)", distinct=False)})""")
def column_profile_estimated(spark, sf):
    """The one-pass profile; its distinct counts are estimates, held against the exact ones within four standard errors."""
    loads = loads_of(table(spark, sf, "events"), "events", "ts")
    exact = profile(*loads).select("load_date", "position", F.col("distinct_values").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.2 * F.col("exact"))
    return profile(*loads, exact=False).join(exact, ["load_date", "position"]).withColumn("estimate_close", near).drop("distinct_values", "exact")


def _months_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate(_EVENTS):
        number = kind in ("integer", "decimal")
        exact = f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round_even(avg({c}), 2) AS mean_value" if number else \
            "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value"
        parts.append(f"""SELECT CAST(date_trunc('month', ts) AS DATE) AS month, {i} AS position, '{c}' AS "column", '{kind}' AS type,
            count(DISTINCT CAST(ts AS DATE)) AS loads, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_pct,
            {exact}, true AS distinct_close, true AS quantiles_close FROM events GROUP BY 1""")
    return " UNION ALL ".join(parts)


@query(_months_sql())
def merged_monthly_profile(spark, sf):
    """Monthly profiles from the stored sketches of daily loads alone. Counts, bounds and means are exact; the distinct counts are held
    against exact ones (four standard errors), the quartiles against their exact ranks (two points of a hundred)."""
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    store = Store(spark, shared_dir(spark, "store"))
    store.write("profiles", load_sketches(df, spec))
    month = "CAST(trunc(load_date, 'MM') AS DATE) AS month"
    got = merged_profile(store.read("profiles"), month)
    distinct = df.withColumn("month", F.trunc("load_date", "MM")).groupBy("month").agg(
        *[F.count_distinct(c).alias(c) for c, _ in _EVENTS]).unpivot("month", [c for c, _ in _EVENTS], "column", "exact")
    marks = got.where("type IN ('integer', 'decimal')").select("month", "column", "p25", "median", "p75")
    cells = df.select(F.trunc("load_date", "MM").alias("month"), F.expr("inline(array(" + ", ".join(
        f"struct('{c}' AS column, CAST({c} AS DOUBLE) AS x)" for c, kind in _EVENTS if kind in ("integer", "decimal")) + "))")).where("x IS NOT NULL")
    ranks = cells.join(marks, ["month", "column"]).groupBy("month", "column").agg(*[
        F.expr(f"count_if(x <= {q}) / count(1) >= {share - 0.02} AND count_if(x < {q}) / count(1) <= {share + 0.02}").alias(f"ok_{q}")
        for q, share in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.065 * F.col("exact"))
    return got.join(distinct, ["month", "column"]).join(ranks, ["month", "column"], "left").select(
        "month", "position", "column", "type", "loads", "n", "null_pct", "min_value", "max_value", "mean_value", near.alias("distinct_close"),
        F.coalesce(F.expr("ok_p25 AND ok_median AND ok_p75"), F.lit(True)).alias("quantiles_close"))


@query("""SELECT * FROM (
    SELECT 'id_customer' AS column_name, 'not_null' AS type, 'high' AS severity, '' AS params FROM customer HAVING count(c_custkey) = count(*)
    UNION ALL SELECT 'id_customer', 'unique', 'critical', '' FROM customer HAVING count(DISTINCT c_custkey) = count(*)
    UNION ALL SELECT 'c_nationkey', 'range', 'medium', 'min 0' FROM customer HAVING min(c_nationkey) >= 0
    UNION ALL SELECT 'c_acctbal', 'range', 'medium', 'min 0' FROM customer HAVING min(c_acctbal) >= 0
    UNION ALL SELECT 'c_name', 'allowed_values', 'medium', string_agg(DISTINCT c_name, ',' ORDER BY c_name) FROM customer HAVING count(DISTINCT c_name) BETWEEN 2 AND 12 AND count(c_name) >= 30
    UNION ALL SELECT 'c_mktsegment', 'allowed_values', 'medium', string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer HAVING count(DISTINCT c_mktsegment) BETWEEN 2 AND 12 AND count(c_mktsegment) >= 30
    UNION ALL SELECT 'event_id', 'not_null', 'high', '' FROM events HAVING count(event_id) = count(*)
    UNION ALL SELECT 'event_id', 'unique', 'critical', '' FROM events HAVING count(DISTINCT event_id) = count(*)
    UNION ALL SELECT 'user_id', 'not_null', 'high', '' FROM events HAVING count(user_id) = count(*)
    UNION ALL SELECT 'user_id', 'unique', 'critical', '' FROM events HAVING count(DISTINCT user_id) = count(*)
    UNION ALL SELECT 'value', 'range', 'medium', 'min 0' FROM events HAVING min(value) >= 0
    UNION ALL SELECT 'event_type', 'allowed_values', 'medium', string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events HAVING count(DISTINCT event_type) BETWEEN 2 AND 12
    UNION ALL SELECT 'props', 'allowed_values', 'medium', string_agg(DISTINCT props, ',' ORDER BY props) FROM events HAVING count(DISTINCT props) BETWEEN 2 AND 12)""")
def suggested_rules(spark, sf):
    """Rules proposed from the profile of customer and of events."""
    rows = []
    for name, column, renamed in (("customer", "", {"c_custkey": "id_customer"}), ("events", "ts", {})):
        df, spec = loads_of(table(spark, sf, name).withColumnsRenamed(renamed), name, column, load_type="incremental")
        for r in suggest_rules(df, spec):
            p = r["params"]
            params = ",".join(p["values"]) if "values" in p else "min 0" if "min" in p else ""
            rows.append((p.get("column") or p["columns"][0], r["type"], r["severity"], params))
    return spark.createDataFrame(rows, "column_name string, type string, severity string, params string")


# ---------------------------------------------------------------- segments
_AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')"


@query(f"""WITH f AS (SELECT c_mktsegment AS segment, o_totalprice AS amount, {_AGE} AS days_late FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION SELECT p_type FROM part),
    a AS (SELECT segment, count(*) AS n, sum(amount) AS total, sum(amount) FILTER (WHERE days_late > 30) AS overdue FROM f GROUP BY 1)
    SELECT segment, coalesce(n, 0) AS n_records, round(coalesce(total, 0), 0) AS total, round(coalesce(overdue, 0), 0) AS overdue,
           CASE WHEN coalesce(total, 0) <> 0 THEN round(100 * coalesce(overdue, 0) / total, 2) ELSE 0.0 END AS overdue_pct FROM s LEFT JOIN a USING (segment)""")
def segment_totals(spark, sf):
    """Orders by market segment; part types are segments without a record."""
    good = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    facts = table(spark, sf, "orders").join(good, F.col("o_custkey") == F.col("c_custkey")) \
        .select("segment", F.col("o_totalprice").alias("amount"), age.alias("days_late"))
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")) \
        .union(table(spark, sf, "part").select("p_type"))
    return segment_indicators(facts, segments, "segment", "amount", "days_late")


@query(f"""SELECT CASE WHEN {_AGE} <= 30 THEN 'A' WHEN {_AGE} <= 60 THEN 'B' WHEN {_AGE} <= 90 THEN 'C' WHEN {_AGE} <= 180 THEN 'D' ELSE 'E' END AS grade,
    count(*) AS n_orders FROM orders GROUP BY 1""")
def grade_buckets(spark, sf):
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").groupBy(grade(age).alias("grade")).agg(F.count(F.lit(1)).alias("n_orders"))


# ----------------------------------------------------------------- scalars
def _swapped(number: str) -> str:
    return f"translate({number}, ',.', '.,')"


@query(f"""SELECT event_id, format('{{:02d}}:{{:02d}}', hour(ts), minute(ts)) AS at,
    CASE WHEN v = floor(v) OR abs(v) >= 1000 THEN {_swapped("format('{:,.0f}', v)")} ELSE {_swapped("format('{:,.2f}', v)")} END AS shown,
    CASE WHEN v = floor(v) THEN {_swapped("format('{:,.0f}', v)")} ELSE {_swapped("format('{:,.2f}', v)")} END AS evidence,
    isodow(ts) - 1 AS weekday, CAST(CAST(ts AS DATE) - 7 AS DATE) AS week_before, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days,
    'https://x.example/' || replace(replace(event_type || ' ' || user_id, ' ', '%20'), ':', '%3A') AS url
    FROM (SELECT *, CASE WHEN event_type = 'view' THEN value * 100 ELSE -value END AS v FROM events)""")
def scalar_functions(spark, sf):
    v = F.when(F.col("event_type") == "view", F.col("value") * 100).otherwise(-F.col("value"))
    day = F.col("ts").cast("date")
    return table(spark, sf, "events").select(
        "event_id", hhmm(minute_of_day(F.col("ts"))).alias("at"), locale_number(v).alias("shown"), evidence_number(v).alias("evidence"),
        F.weekday(day).cast("bigint").alias("weekday"), F.date_sub(day, 7).alias("week_before"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"),
        run_url("https://x.example/{run_id}", F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("url"))
