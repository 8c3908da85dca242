import json
from datetime import date, datetime, timedelta

import pytest

from loadwatch.operators.baseline import replay
from loadwatch.operators import incidents as inc
from loadwatch.session import shared_dir
from loadwatch.streaming.ingest import daily_counts, run_to_table, use_rocksdb, watch_publications
from loadwatch.streaming.state import stateful_bands, stateful_incidents
from test_baseline import MONDAY, SCHEMA, random_series
from test_incidents import check

START = date(2026, 1, 1)


def stream_of(spark, schema, batches):
    """Each batch is one file, written in order, one per micro-batch."""
    path = shared_dir(spark, "source")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bands_carried_between_publications_equal_one_replay(spark):
    use_rocksdb(spark)
    rows = [("t", f"s{k}", d, v, z, w, vol) for k, (z, w, vol) in enumerate([(3.5, True, True), (2.0, False, False)]) for d, v in random_series(k, 80)]
    batches = [[r for r in rows if i * 27 <= (r[2] - MONDAY).days < (i + 1) * 27] for i in range(3)]
    got = run_to_table(stateful_bands(stream_of(spark, SCHEMA, batches)), "bands")
    expected = replay(spark.createDataFrame(rows, SCHEMA)).select(got.columns)
    assert got.count() == 160 and got.exceptAll(expected).isEmpty()


def test_a_day_published_again_replaces_its_point(spark):
    use_rocksdb(spark)
    first = [("t", "a", MONDAY + timedelta(days=i), 100.0 + i % 3, 3.0, False, False) for i in range(20)]
    late = [("t", "a", MONDAY + timedelta(days=5), 200.0, 3.0, False, False), ("t", "a", MONDAY + timedelta(days=20), 101.0, 3.0, False, False)]
    bands = run_to_table(stateful_bands(stream_of(spark, SCHEMA, [first, late])), "bands").collect()
    fifth = [r for r in bands if r.load_date == MONDAY + timedelta(days=5)]
    assert sorted((r.value, r.passed) for r in fifth) == [(102.0, True), (200.0, False)]
    # the last day no longer sees the point that was replaced
    clean = spark.createDataFrame([r for r in first if r[2] != MONDAY + timedelta(days=5)] + late[1:], SCHEMA)
    last = MONDAY + timedelta(days=20)
    (expected,), (got,) = ([r for r in rows if r.load_date == last] for rows in (replay(clean).collect(), bands))
    assert (got.center, got.spread) == (expected.center, expected.spread)


@pytest.mark.parametrize("zone", ["UTC", "America/Bogota"])
def test_days_close_with_the_watermark(spark, zone):
    use_rocksdb(spark)
    rows = [(datetime(2026, 1, 1) + timedelta(minutes=37 * i),) for i in range(400)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        counts = daily_counts(stream_of(spark, "at timestamp_ntz", [rows[:150], rows[150:]]), "at", "t")
        got = {r.load_date: r.value for r in run_to_table(counts, "counts").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    whole = {}
    for (t,) in rows:
        whole[t.date()] = whole.get(t.date(), 0) + 1
    del whole[max(whole)]
    assert got == whole


def test_incidents_with_state_equal_the_windows(spark):
    use_rocksdb(spark)
    pattern = {"a": "ffpfpp", "b": "pffffp", "c": "fpfpfp"}
    rows = [(0, START + timedelta(days=i), 420, t, None, [check("high" if i < 2 else "critical", 1)] if p == "f" else [])
            for t, ps in pattern.items() for i, p in enumerate(ps)]
    batches = [[r for r in rows if (r[1] - START).days // 2 == b] for b in range(3)]
    events = run_to_table(stateful_incidents(stream_of(spark, inc.OBSERVATION_SCHEMA, batches)), "incidents").collect()
    found = inc.incidents(spark.createDataFrame(rows, inc.OBSERVATION_SCHEMA)).collect()
    for kind, column in (("detected", "opened_date"), ("resolved", "resolved_date")):
        assert sorted((e.table, e.load_date) for e in events if e.kind == kind) == sorted((r.table, r[column]) for r in found if r[column])
    last = {}
    for e in sorted(events, key=lambda e: (e.table, e.number, e.load_date, e.position)):
        last[e.table, e.number] = (e.severity, e.loads_failed)
    assert sorted(last.values()) == sorted((r.severity, r.loads_failed) for r in found)


def test_each_publication_is_seen_once(spark, folder):
    seen = []
    checkpoint = shared_dir(spark, "checkpoint")
    for i in range(3):
        with open(f"{folder}/m{i}.json", "w") as f:
            json.dump({"run_id": f"r{i}", "published_at": f"2026-10-0{i + 1}T12:00:00", "dates": [f"2026-10-0{i + 1}"]}, f)
        watch_publications(spark, folder, lambda b, _: seen.extend(r.run_id for r in b.collect()), checkpoint).awaitTermination()
    assert seen == ["r0", "r1", "r2"]


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return None

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")


def test_a_day_published_very_late_is_judged_as_in_the_replay(spark):
    """More than 120 clean points come between the day and its publication."""
    use_rocksdb(spark)
    rows = [("t", "a", MONDAY + timedelta(days=i), 100.0 + i % 5, 3.0, False, False) for i in range(260)]
    late = [(*rows[40][:3], 900.0, *rows[40][4:])]
    expected = {r.load_date: r for r in replay(spark.createDataFrame(rows[:40] + late, SCHEMA)).collect()}[late[0][2]]
    for kept, same in ((None, True), (30, False)):
        bands = run_to_table(stateful_bands(stream_of(spark, SCHEMA, [rows[:40] + rows[41:], late]), kept), "bands")
        (got,) = bands.where(bands.load_date == late[0][2]).collect()
        assert ((got.center, got.spread, got.passed) == (expected.center, expected.spread, expected.passed)) == same
    assert not expected.passed
