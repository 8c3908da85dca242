"""Scans, connector schema, loads, publications and the store."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from loadwatch.model import Field, TableSpec, rules_frame
from loadwatch.session import shared_dir
from loadwatch.sources.connector import (align_to_spec, available_dates, infer_spec, normalize_types, read_load,
                                         scan_csv)
from loadwatch.sources.publications import fingerprint, plan_dates, publication_log, read_manifest
from loadwatch.sources.rulebook import rules_for_tables
from loadwatch.sources.store import Store
from loadwatch_queries.common import loads_of, rules_of, table

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


@query("SELECT * FROM part")
def parquet_scan(spark, sf):
    return table(spark, sf, "part")


@query("SELECT * FROM customer")
def csv_scan(spark, sf):
    customer = table(spark, sf, "customer")
    path = shared_dir(spark, "customer") + ".csv"
    customer.write.option("header", True).csv(path)
    return scan_csv(spark, path, customer.schema)


@query("""SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice, 2) AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""")
def csv_dialect(spark, sf):
    """Orders written with semicolons, points between thousands, decimal commas and the day first, and read back as numbers and dates."""
    orders = table(spark, sf, "orders")
    path = shared_dir(spark, "orders") + ".csv"
    price = F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", ".,")
    orders.select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate")) \
        .write.option("header", True).option("sep", ";").csv(path)
    read = scan_csv(spark, path)
    return read.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice", "o_orderdate")


_TYPED = ("orders", "lineitem", "events", "documents", "embeddings", "customer")


@query(" UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, s.column_name, s.logical_type, u.present FROM (
      SELECT column_name, CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'BOOLEAN') THEN 'integer'
                               WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'decimal'
                               WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'date' ELSE 'text' END AS logical_type
      FROM (DESCRIBE SELECT * FROM {t})) s
    JOIN (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE present) u USING (column_name)"""
    for t in _TYPED))
def inferred_schema(spark, sf):
    out = None
    for name in _TYPED:
        df = table(spark, sf, name)
        spec = infer_spec(df, name)
        cells = F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.lit(c.type).alias("logical_type"),
                                   F.col(f"n_{i}").alias("present")) for i, c in enumerate(spec.columns)])
        one = df.agg(*[F.count(F.col(c.name)).alias(f"n_{i}") for i, c in enumerate(spec.columns)]) \
            .select(F.lit(name).alias("table_name"), F.inline(cells))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_id, CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, user_id, event_type, value, props FROM events""")
def normalized_types(spark, sf):
    return normalize_types(table(spark, sf, "events"))


@query("SELECT * FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def read_one_load(spark, sf):
    events = table(spark, sf, "events")
    spec = infer_spec(events, "events", date_column="ts")
    newest = events.agg(F.max(F.col("ts").cast("date"))).first()[0]
    return read_load(events, spec, newest)


def _dated(spark, sf):
    return [(df, infer_spec(df, name, date_column=column)) for name, column in
            (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")) for df in [table(spark, sf, name)]]


_AVAILABLE = """SELECT CAST(o_orderdate AS DATE) AS load_date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem
                UNION SELECT CAST(ts AS DATE) FROM events"""


@query(_AVAILABLE)
def all_available_dates(spark, sf):
    return available_dates(_dated(spark, sf))


def _order_days(spark, sf, condition):
    return table(spark, sf, "orders").where(condition).select(F.col("o_orderdate").cast("date").alias("load_date"))


@query(f"""WITH manifest AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS load_date FROM orders
                             WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
    wanted AS (SELECT load_date FROM manifest UNION SELECT load_date FROM ({_AVAILABLE})
               WHERE load_date <= (SELECT max(load_date) FROM manifest)),
    pending AS (SELECT load_date FROM wanted WHERE load_date NOT IN (
        SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '5-LOW'))
    SELECT load_date FROM pending UNION ALL SELECT load_date FROM wanted WHERE NOT EXISTS (SELECT 1 FROM pending)""")
def planned_dates_first(spark, sf):
    manifest = _order_days(spark, sf, "o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    processed = _order_days(spark, sf, "o_orderpriority = '5-LOW'")
    return plan_dates(manifest, available_dates(_dated(spark, sf)), processed, first_connection=True)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS load_date FROM orders WHERE o_orderstatus = 'F'")
def planned_dates_republished(spark, sf):
    """Every published date was processed before: the publication repeats them all."""
    manifest = _order_days(spark, sf, "o_orderstatus = 'F'")
    return plan_dates(manifest, None, _order_days(spark, sf, "true"), first_connection=False)


def _manifests(spark, sf) -> str:
    """One manifest per event type: its dates, its rows and the time of its last event."""
    events = table(spark, sf, "events").withColumn("d", F.col("ts").cast("date").cast("string"))
    by_type = events.groupBy("event_type").agg(
        F.concat(F.lit("run/"), "event_type", F.lit(" #"), F.count(F.lit(1)).cast("string")).alias("run_id"),
        F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.collect_set("d").alias("dates"), F.create_map(F.lit("events"), F.count(F.lit(1))).alias("datasets")).drop("event_type")
    path = shared_dir(spark, "manifests")
    by_type.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return path


@query("""SELECT 'run/' || event_type || ' #' || count(*) AS run_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS published_at,
    CAST(max(ts) AS DATE) AS published_date, CAST(hour(max(ts)) * 60 + minute(max(ts)) AS INTEGER) AS published_minute,
    CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS n_dates, min(CAST(ts AS DATE)) AS first_date,
    max(CAST(ts AS DATE)) AS last_date, 1 AS n_datasets, count(*) AS dataset_rows,
    'https://runs.example/#run=' || 'run%2F' || event_type || '%20%23' || count(*) AS run_url
    FROM events GROUP BY event_type""")
def publications(spark, sf):
    return publication_log(read_manifest(spark, _manifests(spark, sf)), "https://runs.example/#run={run_id}")


@query("SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS fingerprint FROM events")
def source_fingerprint(spark, sf):
    return fingerprint(spark, read_manifest(spark, _manifests(spark, sf)), [f"{sf}/events.parquet"])


@query("""SELECT o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS discount, CAST(NULL AS VARCHAR) AS channel,
    CAST(o_orderdate AS DATE) AS load_date FROM orders""")
def aligned_load(spark, sf):
    df = table(spark, sf, "orders").withColumn("load_date", F.col("o_orderdate").cast("date"))
    spec = TableSpec("orders", (Field("o_orderkey", "integer"), Field("discount", "decimal"),
                                Field("o_totalprice", "decimal"), Field("channel", "text")))
    return align_to_spec(df, spec)


def _stored_events(spark, sf):
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    store = Store(spark, shared_dir(spark, "store"))
    store.write_load(df, spec)
    return df, spec, store


@query("""SELECT CAST(ts AS DATE) AS load_date,
    count(*) FILTER (WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) OR event_type <> 'error') AS n_rows
    FROM events GROUP BY 1""")
def republished_load(spark, sf):
    """The newest day published again without its errors replaces that day only."""
    df, spec, store = _stored_events(spark, sf)
    newest = df.agg(F.max("load_date")).first()[0]
    store.write_load(df.where((F.col("load_date") == F.lit(newest)) & (F.col("event_type") != "error")), spec)
    return store.rows(spec).groupBy("load_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT CAST(ts AS DATE) AS load_date, count(*) AS n_rows FROM events
    WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7 GROUP BY 1""")
def retained_rows(spark, sf):
    df, spec, store = _stored_events(spark, sf)
    newest = df.agg(F.max("load_date")).first()[0]
    store.apply_retention([spec], newest)
    return store.rows(spec).groupBy("load_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""WITH m AS (SELECT CAST(o_orderdate AS DATE) AS load_date, count(*) AS n FROM orders GROUP BY 1),
    f AS (SELECT max(load_date) + CAST(1 - date_part('day', max(load_date)) AS INTEGER) AS first_day FROM m)
    SELECT load_date, 'orders' AS "table", 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM m, f
    WHERE load_date >= first_day - 120""")
def retained_metrics(spark, sf):
    """Metrics written, and pruned on the first of the month to the last 120 days."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("load_date")) \
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    store = Store(spark, shared_dir(spark, "store"))
    store.write("metrics", daily.select("load_date", F.lit("orders").alias("table"), F.lit("rows").alias("metric"), "value"))
    newest = store.read("metrics").agg(F.max("load_date")).first()[0]
    store.apply_retention([], newest - timedelta(days=newest.day - 1))
    return store.read("metrics")


@query("""WITH n AS (SELECT 'orders' AS "table", count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
                     UNION ALL SELECT 'part', count(*) FROM part)
    SELECT n."table", n_rows, id, severity FROM n JOIN (VALUES ('orders', 'O1', 'high'), ('orders', 'O2', 'low'),
        ('customer', 'C1', 'critical')) r("table", id, severity) USING ("table")""")
def tables_with_rules(spark, sf):
    """Row counts of the tables joined to their enabled rules, one to many."""
    specs = {n: infer_spec(table(spark, sf, n), n) for n in ("orders", "customer", "part")}
    rules = rules_of(specs["orders"], ("O1", "range", "high", {"column": "o_totalprice", "min": 0}),
                     ("O2", "not_null", "low", {"column": "o_orderstatus"}))
    rules += rules_of(specs["customer"], ("C1", "unique", "critical", {"columns": ["c_custkey"]}),)
    off = [type(r)(**{**r.__dict__, "id": "P1", "table": "part", "enabled": False}) for r in rules[:1]]
    counts = None
    for n in specs:
        one = table(spark, sf, n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(n))
        counts = one if counts is None else counts.unionByName(one)
    return rules_for_tables(counts, rules_frame(spark, rules + off)).select("table", "n_rows", "id", "severity")
