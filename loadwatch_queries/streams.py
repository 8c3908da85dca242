"""The same results from streams: state carried between micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadwatch.model import Catalog, Field, TableSpec
from loadwatch.operators.baseline import outlier_series
from loadwatch.operators.evaluate import daily_stats, rule_facts
from loadwatch.session import shared_dir, stage
from loadwatch.sources.store import Store
from loadwatch.operators import incidents as inc
from loadwatch.operators.baseline import replay
from loadwatch.streaming.incidents import events as incident_events
from loadwatch.streaming.incidents import known_incidents, newest, stateful_log
from loadwatch.streaming.ingest import (REVISIONS, daily_counts, latest_revisions, revise_counts, revised_series, run_to_table, stream_rows, use_rocksdb,
                                        watch_publications)
from loadwatch.streaming.overdue import overdue_stream
from loadwatch.streaming.state import stateful_bands, stateful_incidents
from loadwatch_queries.baselines import _ORDER_SERIES, _daily
from loadwatch_queries.common import ROUNDED_BANDS, band_sql, loads_of, rounded_bands, rules_of, table
from loadwatch_queries.incidents import WITH_ACTIONS, _actions
from loadwatch_queries.sources import _manifests
from loadwatch_queries.state import state, with_state

QUERIES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return register


def _as_stream(spark, df, label, by=None):
    """`df` as a stream of files, one micro-batch per file; `by` splits it into batches in order."""
    path = shared_dir(spark, label)
    if by is None:
        df.write.parquet(path)
    else:
        for (value,) in df.select(by.alias("b")).distinct().orderBy("b").collect():
            df.where(by == F.lit(value)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""WITH RECURSIVE {band_sql(_daily('events', 'CAST(ts AS DATE)', [('rows', 'count(*)', 3.5, False, True)]))}
    {ROUNDED_BANDS} FROM bands WHERE d < (SELECT max(CAST(ts AS DATE)) FROM events)""")
def streamed_volume(spark, sf):
    """Events counted by day with a watermark and judged as each day closes; the newest day is still open."""
    use_rocksdb(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rounded_bands(run_to_table(stateful_bands(daily_counts(events, "ts", "events", "snapshot")), "volume"))


@query(f"WITH RECURSIVE {band_sql(_ORDER_SERIES)} {ROUNDED_BANDS} FROM bands")
def streamed_outliers(spark, sf):
    """Yearly publications of daily order totals, the clean history carried in state between them."""
    use_rocksdb(spark)
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, *[(i, "outlier", "high", {"column": "o_totalprice", "aggregate": a, "z": z})
                             for i, a, z in (("W1", "sum", 2), ("W2", "avg", 2), ("W3", "max", 3))])
    series = stage(outlier_series(daily_stats(df, spec, rules), rule_facts(spark, Catalog((spec,), tuple(rules)))), "series")
    return rounded_bands(run_to_table(stateful_bands(_as_stream(spark, series, "series", F.year("load_date"))), "bands"))


_WEIGHT = "CASE {w} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


@query(with_state(f""", ev AS (SELECT *, max(fails[1].w) OVER run AS w_now, max(fails[1].w) OVER (PARTITION BY tbl, island ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w_before,
        count(*) FILTER (WHERE fail) OVER run AS n, first_value(fails[1].name) OVER run AS title, lag(fail) OVER (PARTITION BY tbl, island ORDER BY d) AS failed
      FROM islands WHERE island > 0 WINDOW run AS (PARTITION BY tbl, island ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    told AS (SELECT *, 0 AS position, 'detected' AS kind, w_now AS w FROM ev WHERE opens UNION ALL SELECT *, 2, 'persists', w_before FROM ev WHERE fail AND NOT opens
      UNION ALL SELECT *, 3, 'escalated', w_now FROM ev WHERE fail AND NOT opens AND w_now > w_before UNION ALL SELECT *, 5, 'resolved', w_now FROM ev WHERE NOT fail AND failed)
    SELECT tbl AS "table", CAST(island AS BIGINT) AS number, d AS load_date, CAST(minute AS INTEGER) AS minute, CAST(position AS INTEGER) AS position, kind,
      {_WEIGHT.format(w='w')} AS severity, title, n AS loads_failed FROM told"""))
def streamed_incidents(spark, sf):
    """Observations as they come: incidents open, persist, rise and resolve with state by table."""
    use_rocksdb(spark)
    seen = state(spark, sf).validation.observations
    week = F.date_trunc("week", F.col("load_date").cast("timestamp")).cast("date")
    events = run_to_table(stateful_incidents(_as_stream(spark, seen, "observations", week)), "incidents")
    return events.select("table", "number", "load_date", "minute", "position", "kind", "severity", "title", "loads_failed")


@query("""SELECT CAST(ts AS DATE) AS load_date, count(*) AS n_rows FROM events GROUP BY 1""")
def streamed_loads(spark, sf):
    """Events published twice as a stream, every day spread over many files and several batches: the batches of a publication add
    up, and the second publication replaces the days of the first."""
    df, spec = loads_of(table(spark, sf, "events"), "events", "ts")
    store, checkpoint, path = Store(spark, shared_dir(spark, "store")), shared_dir(spark, "rows-checkpoint"), shared_dir(spark, "events")
    for published in ("2024-02-01", "2024-02-02"):
        df.withColumn("published", F.lit(published)).repartition(6).write.mode("append").parquet(path)
        rows = spark.readStream.schema(df.withColumn("published", F.lit("")).schema).option("maxFilesPerTrigger", 2).parquet(path)
        stream_rows(rows, spec, store, checkpoint, publication="published").awaitTermination()
    return store.rows(spec).groupBy("load_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT 'run/' || event_type || ' #' || count(*) AS run_id, CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS n_dates FROM events GROUP BY event_type""")
def streamed_publications(spark, sf):
    """Manifests seen once each, although the watch starts twice."""
    folder, out, checkpoint = _manifests(spark, sf), shared_dir(spark, "seen"), shared_dir(spark, "watch-checkpoint")

    def note(batch, batch_id):
        batch.select("run_id", F.size("dates").alias("n_dates")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for _ in range(2):
        watch_publications(spark, folder, note, checkpoint).awaitTermination()
    return spark.read.schema("run_id string, n_dates int").parquet(out).select("run_id", "n_dates")


@query(f"WITH RECURSIVE {band_sql(_ORDER_SERIES)} {ROUNDED_BANDS} FROM bands")
def continued_outliers(spark, sf):
    """Order totals: the days up to the middle of their time in batch, the later ones as a stream that starts from the clean points stored by then."""
    use_rocksdb(spark)
    df, spec = loads_of(table(spark, sf, "orders"), "orders", "o_orderdate")
    rules = rules_of(spec, *[(i, "outlier", "high", {"column": "o_totalprice", "aggregate": a, "z": z}) for i, a, z in (("W1", "sum", 2), ("W2", "avg", 2), ("W3", "max", 3))])
    series = stage(outlier_series(daily_stats(df, spec, rules), rule_facts(spark, Catalog((spec,), tuple(rules)))), "series")
    middle = series.agg(F.percentile(F.unix_date("load_date"), 0.5).cast("int")).first()[0]
    early = stage(replay(series.where(F.unix_date("load_date") < middle)), "early")
    known = early.where("passed").select("table", "check_id", "load_date", "value")
    later = series.where(F.unix_date("load_date") >= middle)
    bands = run_to_table(stateful_bands(_as_stream(spark, later, "series", F.year("load_date")), known=known), "bands")
    return rounded_bands(early).unionByName(rounded_bands(bands))


@query(WITH_ACTIONS)
def continued_incidents(spark, sf):
    """Observations and analyst actions: the first 20 days in batch, the others as two streams that start from the open incidents; all incidents."""
    use_rocksdb(spark)
    s = state(spark, sf)
    dated = F.unix_date("load_date").cast("bigint")
    obs, acts = s.validation.observations.withColumn("seq", dated), _actions(s).withColumn("seq", dated)
    first, last = obs.agg(F.min("seq"), F.max("seq")).first()
    before, after = [x.where(F.col("seq") < first + 20) for x in (obs, acts)], [x.where(F.col("seq") >= first + 20) for x in (obs, acts)]
    tick = obs.where(F.col("seq") == last).withColumn("seq", F.lit(last + 30).cast("bigint"))  # a later publication: it lets the last days through
    week = F.floor(F.col("seq") / 7)
    streams = [_as_stream(spark, after[0].unionByName(tick), "observations", week), _as_stream(spark, after[1], "actions", week)]
    log = run_to_table(stateful_log(incident_events(*streams), 14, known_incidents(*before)), "log")
    ended = inc.incidents(*before).where("resolved_date is not null")
    columns = ["table", "opened_date", "status", "resolution", "resolved_date", "loads_failed"]
    return ended.select(columns).unionByName(newest(log).select(columns))


@query(f"""WITH RECURSIVE {band_sql(_daily('events', 'CAST(ts AS DATE)', [('rows', 'count(*)', 3.5, False, True)]))}
    {ROUNDED_BANDS}, d = (SELECT max(CAST(ts AS DATE)) FROM events) AS provisional FROM bands""")
def streamed_corrections(spark, sf):
    """Events of which every second one comes after all days have been counted: the counts are revised, and so are the verdicts; the newest day is provisional."""
    use_rocksdb(spark)
    events = table(spark, sf, "events").select("event_id", "ts")
    path, checkpoint, source = shared_dir(spark, "revisions"), shared_dir(spark, "revisions-checkpoint"), shared_dir(spark, "events")
    for late in (1, 0):
        events.where(F.col("event_id") % 2 == late).write.mode("append").parquet(source)
        revise_counts(spark.readStream.schema(events.schema).parquet(source), "ts", path, checkpoint).awaitTermination()
    revisions = spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", 1).parquet(path)
    bands = run_to_table(stateful_bands(revised_series(revisions, "events", "snapshot")), "bands")
    last = latest_revisions(bands, ["table", "check_id", "load_date"])
    return rounded_bands(last).join(last.select("load_date", "provisional"), "load_date")


@query("""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), told AS (
      SELECT d, CASE WHEN date_diff('day', (SELECT min(d) FROM days), d) % 2 = 0 THEN 6 ELSE 10 END AS hour FROM days
      WHERE date_diff('day', (SELECT min(d) FROM days), d) % 3 <> 1),
    clock AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM told) + INTERVAL 1 DAY, (SELECT max(d) FROM days) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT c.d AS load_date, t.tbl AS "table", 'fail' AS status, 'source: Events; newest publication: '
      || strftime((SELECT max(d + to_hours(hour)) FROM told WHERE told.d < c.d), '%Y-%m-%d %H:%M') || '; due: ' || t.due AS message
    FROM clock c, (VALUES ('early', 6, '06:00'), ('noon', 12, '12:00')) t(tbl, h, due)
    WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.d = c.d AND told.hour < t.h + 1)""")
def streamed_overdue(spark, sf):
    """Publications of events, one in three days left out and some late, beside a clock that runs two days on: each table fails once a day at its deadline."""
    use_rocksdb(spark)
    days = table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    first = days.agg(F.min("d")).scalar()
    age, start = F.datediff("d", first), F.col("d").cast("timestamp")
    told = days.where(age % 3 != 1).select((start + F.when(age % 2 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 10 HOURS"))).alias("published"))
    clock = days.select((start + F.expr("INTERVAL 71 HOURS")).alias("now"))
    catalog = Catalog(tuple(TableSpec(n, (Field("id", "integer"),), expected_at=m) for n, m in (("early", 360), ("noon", 720))))
    late = overdue_stream(_as_stream(spark, told.coalesce(1), "told"), _as_stream(spark, clock.coalesce(1), "clock"), catalog, title="Events")
    return run_to_table(late, "late").select("load_date", "table", "status", "message")
