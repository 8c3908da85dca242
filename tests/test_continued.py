"""Streams that go on from a store, take late rows as corrections, and hear analysts."""
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadwatch.operators import incidents as inc
from loadwatch.operators.baseline import replay
from loadwatch.session import shared_dir
from loadwatch.streaming.incidents import events, known_incidents, newest, stateful_log
from loadwatch.streaming.ingest import REVISIONS, latest_revisions, revise_counts, revised_series, run_to_table, use_rocksdb
from loadwatch.streaming.state import stateful_bands
from test_baseline import MONDAY, SCHEMA, random_series
from test_incidents import check
from test_streaming import START, stream_of


def test_bands_go_on_from_stored_points(spark):
    use_rocksdb(spark)
    rows = [("t", f"s{k}", d, v, z, w, vol) for k, (z, w, vol) in enumerate([(3.5, True, True), (2.0, False, False)]) for d, v in random_series(k, 60)]
    cut = MONDAY + timedelta(days=40)
    whole = replay(spark.createDataFrame(rows, SCHEMA))
    known = whole.where(F.col("passed") & (F.col("load_date") < F.lit(cut))).select("table", "check_id", "load_date", "value")
    later = [r for r in rows if r[2] >= cut]
    got = run_to_table(stateful_bands(stream_of(spark, SCHEMA, [later]), known=known), "bands")
    assert got.count() == len(later) and got.exceptAll(whole.select(got.columns)).isEmpty()


def log_of(rng, days, tables=("a", "b", "c")):
    """A random history: several observations a day now and then, actions between them."""
    obs, acts = [], []
    for d in range(days):
        for t in tables:
            for k in range(1 if rng.random() < 0.8 else 2):
                fails = [check(rng.choice(["low", "high", "critical"]), 1)] if rng.random() < 0.55 else []
                moment = (d + 1, START + timedelta(days=d - (3 if rng.random() < 0.1 else 0)), 400 + 10 * k, t)
                obs.append((*moment, rng.choice([None, f"run{d}"]), fails))
                if rng.random() < 0.2:
                    acts.append((*moment, rng.choice(["resolve", "escalate"]), "", "ana"))
    return obs, acts


def shown(df):
    columns = ["table", "severity", "title", "status", "opened_date", "opened_minute", "resolved_date", "resolved_minute", "resolution", "loads_failed", "run_id", "checks"]
    return df.select(*columns)


@pytest.mark.parametrize("started", [0, 14])
def test_incidents_with_actions_equal_the_windows(spark, started):
    use_rocksdb(spark)
    rng = random.Random(3 + started)
    obs, acts = log_of(rng, 24)
    frames = [spark.createDataFrame(obs, inc.OBSERVATION_SCHEMA), spark.createDataFrame(acts, inc.ACTION_SCHEMA)]
    whole = inc.incidents(*frames)
    before = [f.where(F.col("seq") <= started) for f in frames]
    known = known_incidents(*before) if started else None
    ends = [(99, START, 0, t, None, []) for t in "abc"]  # a later publication lets the last events through
    new_obs, new_acts = [o for o in obs if o[0] > started], [a for a in acts if a[0] > started]
    o = stream_of(spark, inc.OBSERVATION_SCHEMA, [[r for r in new_obs if (r[0] - started - 1) // 5 == k] for k in range(5)] + [ends])
    a = stream_of(spark, inc.ACTION_SCHEMA, [[r for r in new_acts if (r[0] - started - 1) // 5 == k] for k in (0, 2, 1, 3, 4)] if started else [new_acts])
    got = newest(run_to_table(stateful_log(events(o, a), 12, known), "log"))
    first = {r.table: r.number for r in known.where("open <> ''").collect()} if started else {}
    old = inc.incidents(*before).where("resolved_date is not null") if started else whole.limit(0)
    want = shown(whole).exceptAll(shown(old))
    assert shown(got).exceptAll(want).isEmpty() and want.exceptAll(shown(got)).isEmpty() and got.count() > 5
    assert all(n in {r.number for r in got.where(F.col("table") == t).collect()} for t, n in first.items())
    assert {r.resolution for r in got.collect()} >= {"manual", "automatic"}


def test_late_rows_correct_their_day(spark):
    use_rocksdb(spark)
    path, checkpoint, source = shared_dir(spark, "revisions"), shared_dir(spark, "checkpoint"), shared_dir(spark, "rows")
    rng = random.Random(5)
    rows = [(datetime(2026, 1, 1 + d, rng.randrange(24)), i) for d in range(20) for i in range(100 + d)]
    late = [r for i, r in enumerate(rows) if i % 7 == 0 and r[0].day in (3, 9)]
    first = [r for r in rows if r not in late]
    for part in (first[:900], first[900:], late):
        spark.createDataFrame(part, "ts timestamp_ntz, id int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp_ntz, id int").parquet(source)
        revise_counts(stream, "ts", path, checkpoint).awaitTermination()
    counts = spark.read.schema(REVISIONS).parquet(path)
    newest_counts = {r.load_date: (r.row_count, r.provisional) for r in latest_revisions(counts, ["load_date"]).collect()}
    assert newest_counts == {date(2026, 1, 1 + d): (100 + d, d == 19) for d in range(20)}
    stream = spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", 1).parquet(path)
    bands = latest_revisions(run_to_table(stateful_bands(revised_series(stream, "t", "snapshot")), "bands"), ["load_date"])
    got = {r.load_date: (r.value, r.passed) for r in bands.collect()}
    assert got[date(2026, 1, 3)] == (102.0, True) and got[date(2026, 1, 9)][0] == 108.0 and len(got) == 20


def test_a_source_is_overdue_once_a_day_and_table(spark):
    from loadwatch.model import Catalog, Field, TableSpec, specs_frame
    from loadwatch.operators.monitors import overdue_source
    from loadwatch.streaming.overdue import overdue_stream
    use_rocksdb(spark)
    catalog = Catalog(tuple(TableSpec(n, (Field("id", "integer"),), expected_at=m) for n, m in (("early", 360), ("noon", 720))))
    published = [datetime(2026, 1, d, h) for d, h in ((1, 6), (2, 10), (3, 5), (6, 17), (7, 6))]
    clock = [datetime(2026, 1, d, h, 30) for d in range(1, 10) for h in (8, 15, 23)]
    path = [shared_dir(spark, "told"), shared_dir(spark, "clock")]
    out, checkpoint = shared_dir(spark, "late"), shared_dir(spark, "late-checkpoint")
    for day in range(1, 10):  # one run a day, restarted from its checkpoint: the publications of the day, then its clock
        for p, rows in ((path[0], [t for t in published if t.day == day]), (path[1], [t for t in clock if t.day == day])):
            spark.createDataFrame([(t,) for t in rows], "t timestamp").coalesce(1).write.mode("append").parquet(p)
        told, now = (spark.readStream.schema("t timestamp").parquet(p).withColumnRenamed("t", n) for p, n in zip(path, ("published", "now")))
        run_to_table(overdue_stream(told, now, catalog), "late", out, checkpoint)
    late = spark.read.parquet(out).select("load_date", "table", "message").collect()
    want = set()
    for now in sorted(clock):
        log = spark.createDataFrame([(t,) for t in published if t < now], "published timestamp")
        want |= {(r.load_date, r.table, r.message) for r in overdue_source(log, specs_frame(spark, catalog), now).collect()}
    got = [(r.load_date, r.table, r.message) for r in late]
    assert len(set(got)) == len(got) == 11 and set(got) == want
