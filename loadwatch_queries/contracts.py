"""Connectors, rule catalogues, the rules they accept, typing, and a source synchronised end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwatch.model import Catalog, Field, Rule, TableSpec, rules_frame, small_frame
from loadwatch.operators.baseline import outlier_series
from loadwatch.operators.evaluate import budgeted_sql_stats, daily_stats, error_results, evaluate_rules, failing_evidence, row_results, rule_facts
from loadwatch.operators.rules import rule_sql, validate_rule, validate_sql_condition
from loadwatch.plans.monitor import Monitor
from loadwatch.plans.validate import collect_stats
from loadwatch.session import shared_dir, stage
from loadwatch.sources.connector import align_to_spec, infer_spec, load_connector
from loadwatch.sources.publications import parse_manifest
from loadwatch.sources.rulebook import keep_rules, kept_rules, rules_for_tables
from loadwatch.sources.store import Store
from loadwatch.streaming.ingest import run_to_table, use_rocksdb
from loadwatch.streaming.state import stateful_bands
from loadwatch_queries.baselines import _ORDER_SERIES
from loadwatch_queries.common import ROUNDED_BANDS, band_sql, loads_of, rounded_bands, rules_of, shown, table

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


_SOURCE = ("orders", "customer", "part", "nation")


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS n_columns,
    {i} AS position, (SELECT count(*) FROM {t}) AS n_rows, '{'incremental' if t == 'orders' else 'snapshot'}' AS load_type FROM (SELECT 1)""" for i, t in enumerate(_SOURCE)))
def loaded_connector(spark, sf):
    """A connector read from its configuration: contracts captured from the files, and the tables as published now."""
    kinds = {"orders": {"date_column": "o_orderdate"}}
    cfg = {"source": "shop", "path": [f"{sf}/nowhere", sf], "expected_at": "06:30",
           "tables": [{"name": t, **kinds.get(t, {"load_type": "snapshot"})} for t in _SOURCE]}
    con = load_connector(spark, cfg)
    parts = []
    for i, t in enumerate(_SOURCE):
        df, received = con.current(spark, t)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table"), F.lit(len(received)).cast("long").alias("n_columns"), F.lit(i).alias("position"), "n_rows",
            F.lit(con.spec(t).load_type).alias("load_type")))
    return reduce(DataFrame.unionByName, parts)


@query("""WITH n AS (SELECT 'orders' AS "table", count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)
    SELECT "table", n_rows, id, severity, type FROM n JOIN (VALUES ('orders', 'R001', 'high', 'range'), ('orders', 'R002', 'low', 'not_null'),
        ('customer', 'R003', 'critical', 'unique')) r("table", id, severity, type) USING ("table")""")
def stored_rules(spark, sf):
    """A rule catalogue kept twice, the second time changed, read back and joined to its tables."""
    orders, customer = (infer_spec(table(spark, sf, n), n) for n in ("orders", "customer"))
    rules = rules_of(orders, ("R001", "range", "high", {"column": "o_totalprice", "min": 0}), ("R002", "not_null", "low", {"column": "o_orderstatus"}))
    folder = shared_dir(spark, "rules")
    keep_rules(spark, rules, folder)
    keep_rules(spark, rules + rules_of(customer, ("R003", "unique", "critical", {"columns": ["c_custkey"]})), folder)
    counts = reduce(DataFrame.unionByName, [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(n))
                                            for n in ("orders", "customer")])
    return rules_for_tables(counts, rules_frame(spark, kept_rules(spark, folder))).select("table", "n_rows", "id", "severity", "type")


_CONDITIONS = (("o_totalprice > 200000", True), ("o_orderstatus = 'F' AND o_custkey % 7 = 0", True), ("  o_orderkey IN (SELECT max(o_orderkey) FROM orders)  ", False),
               ("1 = 1; DROP TABLE orders", False), ("o_custkey > 0 -- all", False), ("", False), ("o_custkey > 0 OR " * 60 + "false", False))
_COUNTED = [(i, c) for i, (c, ok) in enumerate(_CONDITIONS) if ok]


@query(f"""SELECT i AS position, false AS accepted, CAST(NULL AS BIGINT) AS n_rows FROM (VALUES (3), (4), (5), (6)) v(i)
    UNION ALL SELECT 2, true, count(*) FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders)
    UNION ALL {' UNION ALL '.join(f"SELECT {i}, true, count(*) FROM orders WHERE {c}" for i, c in _COUNTED)}""")
def accepted_conditions(spark, sf):
    """Custom conditions, which of them may run, and the rows of orders they find."""
    orders = table(spark, sf, "orders")
    orders.createOrReplaceTempView("orders")
    parts = []
    for i, (condition, _) in enumerate(_CONDITIONS):
        try:
            text, ok = validate_sql_condition(condition), True
        except ValueError:
            text, ok = "false", False
        found = orders.where(text).agg(F.count(F.lit(1)).alias("n"))
        parts.append(found.select(F.lit(i).alias("position"), F.lit(ok).alias("accepted"), F.when(F.lit(ok), F.col("n")).alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)


_OFFERED = (("range", "high", {"column": "o_totalprice", "min": 1000}), ("range", "high", {"column": "o_orderstatus", "min": 0}), ("range", "high", {"column": "o_totalprice"}),
            ("allowed_values", "low", {"column": "o_orderstatus", "values": "F, O"}), ("allowed_values", "low", {"column": "o_orderstatus", "values": []}),
            ("compare", "low", {"column": "o_custkey", "operator": "<", "other_column": "o_orderkey"}), ("compare", "low", {"column": "o_custkey", "operator": "~", "other_column": "o_orderkey"}),
            ("not_null", "urgent", {"column": "o_custkey"}), ("unique", "low", {"columns": []}), ("outlier", "low", {"column": "o_orderstatus", "aggregate": "sum"}), ("nothing", "low", {}))


@query("""WITH bad AS (SELECT 0 AS position, count(*) FILTER (WHERE o_totalprice < 1000) AS n FROM orders
    UNION ALL SELECT 3, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 5, count(*) FILTER (WHERE NOT o_custkey < o_orderkey) FROM orders)
    SELECT CAST(i AS INTEGER) AS position, n IS NOT NULL AS accepted, n AS failing_rows FROM range(11) r(i) LEFT JOIN bad ON position = i""")
def validated_rules(spark, sf):
    """Rules offered for orders: accepted or not, and the rows that break the accepted ones."""
    df, spec = loads_of(table(spark, sf, "orders"), "orders")
    accepted = []
    for i, (kind, severity, params) in enumerate(_OFFERED):
        try:
            accepted.append(validate_rule(Rule(f"N{i}", "orders", kind, severity, params), Catalog((spec,))))
        except ValueError:
            continue
    checks = evaluate_rules(df, spec, accepted).select("check_id", "failing_rows")
    offered = small_frame(spark, [(i, f"N{i}") for i in range(len(_OFFERED))], "position int, check_id string")
    return offered.join(checks, "check_id", "left").select("position", F.col("failing_rows").isNotNull().alias("accepted"), "failing_rows")


_SHOWN_RULES = (("S1", "not_null", "high", {"column": "event_type"}), ("S2", "range", "high", {"column": "value", "min": 5, "max": 200}),
                ("S3", "allowed_values", "low", {"column": "event_type", "values": ["click", "it's"]}),
                ("S4", "compare", "low", {"column": "user_id", "operator": "<=", "other_column": "event_id"}), ("S5", "sql", "low", {"condition": "user_id % 10 = 3"}),
                ("S6", "same_day", "low", {"column": "ts"}), ("S7", "unique", "low", {"columns": ["user_id", "event_type"]}))


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events),
    r AS (SELECT d, 'S1' AS id, event_type IS NULL OR trim(event_type) = '' AS bad FROM e UNION ALL SELECT d, 'S2', value < 5 OR value > 200 FROM e
    UNION ALL SELECT d, 'S3', event_type NOT IN ('click', 'it''s') FROM e UNION ALL SELECT d, 'S4', NOT user_id <= event_id FROM e UNION ALL SELECT d, 'S5', user_id % 10 = 3 FROM e
    UNION ALL SELECT d, 'S7', true FROM (SELECT d, user_id, event_type FROM e GROUP BY ALL HAVING count(*) > 1))
    SELECT d AS load_date, id AS check_id, count(*) AS n_rows FROM r WHERE bad GROUP BY ALL""")
def shown_sql(spark, sf):
    """The SQL shown to people, run as it is: the rows it gives for every load of events."""
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    df.createOrReplaceTempView("events")
    parts = []
    for r in rules_of(spec, *_SHOWN_RULES):
        text = rule_sql(r, spec).replace("load_date = :day", "true")
        text = text.replace("SELECT `user_id`", "SELECT load_date, `user_id`").replace("GROUP BY `user_id`", "GROUP BY load_date, `user_id`")
        parts.append(spark.sql(text).groupBy("load_date").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("check_id", F.lit(r.id)))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'B1' AS check_id, CASE WHEN count(*) FILTER (WHERE o_custkey % 2 = 0) > 0 THEN 'fail' ELSE 'ok' END AS status,
    count(*) FILTER (WHERE o_custkey % 2 = 0) AS failing_rows FROM orders UNION ALL SELECT 'B2', 'error', 0""")
def cancelled_rule(spark, sf):
    """Custom conditions with a time limit: the one that would never end is cancelled and becomes an error."""
    df, spec = loads_of(table(spark, sf, "orders"), "orders")
    rules = rules_of(spec, ("B1", "sql", "low", {"condition": "o_custkey % 2 = 0"}),
                     ("B2", "sql", "low", {"condition": "o_custkey < (SELECT count_if(hash(id) % 7 = 1) FROM range(1000000000000000))"}))

    def stats_of(some):
        return daily_stats(df, spec, some).where("kind = 'row'")

    done, reasons = budgeted_sql_stats(spark, stats_of, rules[:1], 600)
    late, why = budgeted_sql_stats(spark, stats_of, rules[1:], 2)
    days = df.groupBy("load_date").agg(F.count(F.lit(1)).alias("total_rows"))
    stats = reduce(DataFrame.unionByName, done + late)
    facts = rule_facts(spark, Catalog((spec,), tuple(rules)))
    checks = row_results(stats, facts).unionByName(error_results(days, spec, rules, {**reasons, **why}))
    return checks.select("check_id", "status", "failing_rows")


@query("""SELECT CAST(o_orderdate AS DATE) AS load_date, id AS check_id, count(*) FILTER (WHERE CASE id WHEN 'C1' THEN o_totalprice > 200000 ELSE o_custkey % 5 = 0 END) AS failing_rows
    FROM orders, (VALUES ('C1'), ('C3')) r(id) GROUP BY ALL""")
def failing_condition(spark, sf):
    """One of three custom conditions fails on the data: it is found, and the others give their counts."""
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, ("C1", "sql", "low", {"condition": "o_totalprice > 200000"}), ("C2", "sql", "low", {"condition": "cast(o_orderstatus AS int) > 0"}),
                     ("C3", "sql", "low", {"condition": "o_custkey % 5 = 0"}))
    stats, reasons = collect_stats(Catalog((spec,), tuple(rules)), {"orders": df})
    broken = small_frame(spark, [(i,) for i in reasons["orders"]], "check_id string")
    return stats.where("kind = 'row'").join(broken, "check_id", "left_anti").select("load_date", "check_id", "failing_rows")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""")
def drifted_types(spark, sf):
    """Columns that arrive with other types than the contract's, cast to it; what doesn't fit is NULL."""
    orders = table(spark, sf, "orders")
    spec = TableSpec("orders", (Field("o_orderkey", "integer", spark_type="bigint"), Field("o_totalprice", "decimal", spark_type="double"),
                                Field("o_custkey", "text", spark_type="string")))
    return align_to_spec(orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_custkey",
                                       F.when(F.col("o_custkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice")), spec)


_BIG = 9007199254740992


@query(f"SELECT count(*) FILTER (WHERE l_partkey + {_BIG} NOT IN ({_BIG + 1}, {_BIG + 2}, {_BIG + 5})) AS failing_rows, count(*) AS total_rows FROM lineitem")
def large_integers(spark, sf):
    """Allowed integers beyond the precision of a double."""
    lines = table(spark, sf, "lineitem").select((F.col("l_partkey").cast("bigint") + F.lit(_BIG)).alias("n"))
    df, spec = loads_of(lines, "lines")
    rules = rules_of(spec, ("L1", "allowed_values", "low", {"column": "n", "values": [str(_BIG + 1), _BIG + 2, f"{_BIG + 5}.0"]}))
    return evaluate_rules(df, spec, rules).select("failing_rows", "total_rows")


@query("""WITH m AS (SELECT CAST(o_orderdate AS DATE) AS load_date, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT max(load_date) AS first_day FROM m WHERE day(load_date) = 1)
    SELECT load_date, 'orders' AS "table", 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM m, f WHERE load_date >= first_day - 120""")
def retained_history_within_publication(spark, sf):
    """One publication of all order days, which ends within a month: history is cut at the last first of a month it holds."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("load_date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    store = Store(spark, shared_dir(spark, "store"))
    store.write("metrics", daily.select("load_date", F.lit("orders").alias("table"), F.lit("rows").alias("metric"), "value"))
    days = [r[0] for r in daily.select("load_date").orderBy("load_date").collect()]  # calendar days
    store.apply_retention([], days[-1], validated=days)
    return store.read("metrics")


_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY 1)"
_LATE = f"(SELECT d FROM {_DAYS} LIMIT 1 OFFSET 200)"


@query(f"WITH RECURSIVE {band_sql(f'SELECT * FROM ({_ORDER_SERIES}) WHERE d <= {_LATE}')} {ROUNDED_BANDS} FROM bands WHERE d = {_LATE}")
def streamed_late_day(spark, sf):
    """A day of orders published after all others, with far more than 120 clean points in between: judged as in the replay."""
    use_rocksdb(spark)
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, *[(i, "outlier", "high", {"column": "o_totalprice", "aggregate": a, "z": z}) for i, a, z in (("W1", "sum", 2), ("W2", "avg", 2), ("W3", "max", 3))])
    series = stage(outlier_series(daily_stats(df, spec, rules), rule_facts(spark, Catalog((spec,), tuple(rules)))), "series")
    late = series.select("load_date").distinct().orderBy("load_date").offset(200).limit(1).first()[0]
    path = shared_dir(spark, "late")
    for part in (F.col("load_date") != F.lit(late), F.col("load_date") == F.lit(late)):
        series.where(part).coalesce(1).write.mode("append").parquet(path)  # the first publication, and the late one
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(path)
    bands = run_to_table(stateful_bands(stream), "bands")
    return rounded_bands(bands.where(F.col("load_date") == F.lit(late)))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS load_date, 'clicks' AS "table", count(*) AS row_count FROM events WHERE event_type = 'click' GROUP BY 1
    UNION ALL SELECT CAST(ts AS DATE), 'views', count(*) FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) >= (SELECT min(CAST(ts AS DATE)) FROM events) + 3 GROUP BY 1),
    days AS (SELECT DISTINCT CAST(ts AS DATE) AS load_date FROM events WHERE event_type IN ('click', 'view')),
    grid AS (SELECT load_date, t AS "table" FROM days, (VALUES ('clicks'), ('views')) v(t))
    SELECT load_date, "table", coalesce(row_count, 0) AS row_count, CAST(3 AS BIGINT) AS n_rules FROM grid LEFT JOIN a USING (load_date, "table")""")
def synced_source(spark, sf):
    """A source of two tables, one of which starts three days later, synchronised whole: loads, and the suggested rules that judged them."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "ts", F.abs("value").alias("value"), "event_type")
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    folder = shared_dir(spark, "source")
    for name, rows in (("clicks", events.where("event_type = 'click'")), ("views", events.where((F.col("event_type") == "view") & (F.to_date("ts") >= F.date_add(F.lit(first), 3))))):
        rows.drop("event_type").write.parquet(f"{folder}/{name}.parquet")
    days = events.where("event_type in ('click', 'view')").select(F.to_date("ts").cast("string").alias("d")).distinct()
    manifest = days.agg(F.to_json(F.struct(F.lit("run").alias("run_id"), F.concat(F.max("d"), F.lit("T23:30:00")).alias("published_at"), F.sort_array(F.collect_list("d")).alias("dates"))).alias("value"))
    manifest.write.text(f"{folder}/manifest")
    con = load_connector(spark, {"source": "web", "path": folder, "manifest": "manifest", "expected_at": "23:59",
                                 "tables": [{"name": "clicks", "date_column": "ts"}, {"name": "views", "date_column": "ts"}]})
    store = Store(spark, shared_dir(spark, "store"))
    Monitor(spark, con, store).sync()
    rules = store.read("check_results").where("kind = 'rule'").groupBy("load_date", "table").agg(F.count(F.lit(1)).alias("n_rules"))
    return store.read("loads").join(rules, ["load_date", "table"], "left").select("load_date", "table", "row_count", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS load_date, user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY load_date ORDER BY n DESC, user_id, event_type) AS position FROM e)
    SELECT load_date, 'E1' AS check_id, CAST(position AS INTEGER) AS position, 'user_id=' || user_id || ', event_type=' || event_type || ' (x' || n || ')' AS shown FROM r WHERE position <= 5
    UNION ALL SELECT load_date, 'E2', CAST(position AS INTEGER), shown FROM (
        SELECT CAST(ts AS DATE) AS load_date, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS position,
            'event_id=' || replace(format('{:,}', event_id), ',', '.') || ', user_id=' || user_id || ', event_type=' || event_type AS shown FROM events WHERE user_id % 10 = 3) WHERE position <= 5""")
def kept_evidence(spark, sf):
    """What is kept with failing checks: the most repeated keys, and the first bad rows, of every load."""
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    few = TableSpec("events", tuple(Field(c.name, "text", spark_type="string") if c.name != "event_id" else c for c in spec.columns if c.name in ("event_id", "user_id", "event_type")))
    df = df.select("event_id", F.col("user_id"), "event_type", "load_date")
    rules = rules_of(few, ("E1", "unique", "high", {"columns": ["user_id", "event_type"]}), ("E2", "sql", "low", {"condition": "user_id % 10 = 3"}))
    return failing_evidence(df, few, rules).select("load_date", "check_id", "position", "shown")


_UNIQUE = {"K1": ["l_orderkey", "l_linenumber"], "K2": ["l_partkey"], "K3": ["l_suppkey", "l_shipdate"], "K4": ["l_returnflag", "l_quantity"], "K5": ["l_orderkey"]}


@query(" UNION ALL ".join(f"""SELECT DATE '2024-01-30' AS load_date, '{i}' AS check_id, CASE WHEN sum(c - 1) > 0 THEN 'fail' ELSE 'ok' END AS status,
    CAST(sum(c - 1) AS DOUBLE) AS value, CAST(sum(c - 1) AS BIGINT) AS failing_rows, CAST(sum(c) AS BIGINT) AS total_rows
    FROM (SELECT count(*) AS c FROM lineitem GROUP BY {', '.join(k)})""" for i, k in _UNIQUE.items()))
def several_unique_rules(spark, sf):
    """Five uniqueness rules of one table, in one scan and one shuffle."""
    df, spec = loads_of(table(spark, sf, "lineitem"), "lineitem")
    rules = rules_of(spec, *[(i, "unique", "high", {"columns": k}) for i, k in _UNIQUE.items()])
    return shown(evaluate_rules(df, spec, rules))


def _manifest(spark, dates: list[str]) -> DataFrame:
    """The rows of one publication, at 06:00 of its last date."""
    rows = [("run", f"{dates[-1]}T06:00:00", dates, None)]
    return parse_manifest(small_frame(spark, rows, "run_id string, published_at string, dates array<string>, datasets map<string,bigint>"))


_ONE_DAY_RULES = (("orders", "O1", "not_null", {"column": "o_custkey"}), ("orders", "O2", "range", {"column": "o_totalprice", "max": 200000, "max_pct": 5}),
                  ("orders", "O3", "allowed_values", {"column": "o_orderstatus", "values": ["F", "O"]}), ("orders", "O4", "unique", {"columns": ["o_custkey"]}),
                  ("orders", "O5", "sql", {"condition": "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"}),
                  ("orders", "O6", "outlier", {"column": "o_custkey", "aggregate": "sum"}), ("orders", "O7", "sql", {"condition": "o_totalprice < 1000"}),
                  ("customer", "C1", "sql", {"condition": "c_custkey NOT IN (SELECT o_custkey FROM t_orders)"}), ("customer", "C2", "unique", {"columns": ["c_custkey"]}))


@query("""WITH bad AS (
    SELECT 'orders' AS "table", 'O1' AS check_id, count(*) FILTER (WHERE o_custkey IS NULL) AS b, 0 AS tol, count(*) AS n FROM orders
    UNION ALL SELECT 'orders', 'O2', count(*) FILTER (WHERE o_totalprice > 200000), 5, count(*) FROM orders
    UNION ALL SELECT 'orders', 'O3', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), 0, count(*) FROM orders
    UNION ALL SELECT 'orders', 'O4', count(*) - count(DISTINCT o_custkey), 0, count(*) FROM orders
    UNION ALL SELECT 'orders', 'O5', count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)), 0, count(*) FROM orders
    UNION ALL SELECT 'orders', 'O6', 0, 0, count(*) FROM orders
    UNION ALL SELECT 'orders', 'O7', count(*) FILTER (WHERE o_totalprice < 1000), 0, count(*) FROM orders
    UNION ALL SELECT 'customer', 'C1', count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 0, count(*) FROM customer
    UNION ALL SELECT 'customer', 'C2', count(*) - count(DISTINCT c_custkey), 0, count(*) FROM customer)
    SELECT DATE '2024-01-30' AS load_date, "table", check_id, CASE WHEN b > 0 AND 100.0::DOUBLE * b / n > tol THEN 'fail' ELSE 'ok' END AS status,
      CASE WHEN check_id = 'O6' THEN (SELECT CAST(sum(o_custkey) AS DOUBLE) FROM orders) WHEN check_id IN ('O4', 'C2') THEN CAST(b AS DOUBLE)
           ELSE round_even(100.0::DOUBLE * b / n, 3) END AS value, b AS failing_rows, n AS total_rows FROM bad""")
def synced_one_day(spark, sf):
    """Two whole tables delivered on one day: the job that stores the rows measures the row rules and aggregates; conditions name the other table."""
    con = load_connector(spark, {"source": "shop", "path": sf, "expected_at": "07:00",
                                 "tables": [{"name": t, "load_type": "snapshot"} for t in ("orders", "customer")],
                                 "rules": [{"id": i, "table": t, "type": k, "severity": "high", "params": p} for t, i, k, p in _ONE_DAY_RULES]})
    store = Store(spark, shared_dir(spark, "store"))
    Monitor(spark, con, store).sync(_manifest(spark, ["2024-01-30"]))
    return store.read("check_results").where("kind = 'rule'").select("load_date", "table", "check_id", "status", "value", "failing_rows", "total_rows")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, * FROM events)
    SELECT d AS load_date, 'X1' AS check_id, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM e p WHERE p.d = c.d AND p.event_type = 'purchase')) AS failing_rows,
      count(*) AS total_rows FROM e c WHERE event_type = 'click' GROUP BY 1
    UNION ALL SELECT d, 'X2', count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM e p WHERE p.d = c.d AND p.event_type = 'click')), count(*)
    FROM e c WHERE event_type = 'purchase' GROUP BY 1""")
def rules_across_tables(spark, sf):
    """Conditions of two tables over each other: every load against the other's load of the same day, through a whole synchronisation."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    folder = shared_dir(spark, "source")
    for name, kind in (("clicks", "click"), ("purchases", "purchase")):
        events.where(F.col("event_type") == kind).write.parquet(f"{folder}/{name}.parquet")
    con = load_connector(spark, {"source": "web", "path": folder, "expected_at": "07:00", "tables": [{"name": n, "date_column": "ts"} for n in ("clicks", "purchases")],
                                 "rules": [{"id": i, "table": t, "type": "sql", "severity": "low", "params": {"condition": c}} for t, i, c in (
                                     ("clicks", "X1", "user_id IN (SELECT user_id FROM purchases)"), ("purchases", "X2", "user_id NOT IN (SELECT user_id FROM clicks)"))]})
    days = sorted(str(r[0]) for r in events.select(F.to_date("ts")).distinct().collect())  # calendar days
    store = Store(spark, shared_dir(spark, "store"))
    Monitor(spark, con, store).sync(_manifest(spark, days))
    return store.read("check_results").where("kind = 'rule'").select("load_date", "check_id", "failing_rows", "total_rows")
