import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loadwatch.model import Field, TableSpec
from loadwatch.plans.monitor import Monitor
from loadwatch.plans.validate import validate
from loadwatch.sources.connector import (align_to_spec, available_dates, infer_spec, load_connector, normalize_types, read_load,
                                         scan_csv, tag_loads)
from loadwatch.sources.publications import fingerprint, plan_dates, read_manifest
from loadwatch.sources.store import Store

START = date(2026, 9, 1)


def publish(spark, gold, days=10, copied=None, published="2026-10-05T12:00:00+00:00", listed=None, drop=None):
    """A small source: payments and indicators by day, clients as a snapshot, and the manifest of the publication."""
    pay = spark.range(days * 60).selectExpr(
        "concat('P-', id div 60, '-', id % 60) id_payment", "concat('C-', id % 40) id_client", "if(id % 3 = 0, 'pse', 'card') method",
        "1000.0D + id % 60 amount", "date_add(date'2026-09-01', cast(id div 60 as int)) paid_on")
    if copied is not None:
        pay = pay.unionAll(pay.where(F.col("paid_on") == F.lit(START + timedelta(days=copied))))
    if drop:
        pay = pay.drop(drop)
    ind = spark.range(days).selectExpr("date_add(date'2026-09-01', cast(id as int)) paid_on", "0.9D rate", "60L payments")
    clients = spark.range(40).selectExpr("concat('C-', id) id_client", "'CC' kind")
    for name, df in (("payments", pay), ("indicators", ind), ("clients", clients)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{gold}/{name}.parquet")
    dates = [(START + timedelta(days=d)).isoformat() for d in range(days)]
    with open(f"{gold}/manifest.json", "w") as f:
        json.dump({"run_id": f"run-{days}", "dates": dates if listed is None else listed, "published_at": published, "datasets": {}}, f)


def config(gold, expected="23:59", **more):
    return {"source": "test", "title": "Test source", "path": [f"{gold}/nowhere", str(gold)], "manifest": "manifest.json", "expected_at": expected,
            "owner": "Data", "email": "data@x.example", "run_url": "http://x/#run={run_id}",
            "tables": [{"name": "payments", "date_column": "paid_on", "consumers": ["Board"]}, {"name": "indicators", "date_column": "paid_on"},
                       {"name": "clients", "load_type": "snapshot"}],
            "rules": [{"table": "payments", "type": "unico", "severity": "critica", "params": {"columns": ["id_payment"]}},
                      {"table": "payments", "type": "range", "severity": "high", "params": {"column": "amount", "min": 1}},
                      {"table": "payments", "type": "outlier", "severity": "high", "params": {"column": "amount", "aggregate": "suma", "z": 4, "same_weekday": False}}],
            **more}


@pytest.fixture(scope="module")
def gold(tmp_path_factory):
    return tmp_path_factory.mktemp("gold")


@pytest.fixture(scope="module")
def monitor(spark, gold, tmp_path_factory):
    publish(spark, gold)
    m = Monitor(spark, load_connector(spark, config(gold)), Store(spark, str(tmp_path_factory.mktemp("store"))))
    m.first_days = m.sync()
    return m


def one(m, name, condition="true"):
    return m.store.read(name).where(condition)


def test_schema_of_any_table_and_whole_history(monitor):
    assert monitor.connector.path.endswith("gold0")
    assert {c.name: c.type for c in monitor.catalog.spec("payments").columns} == {
        "id_payment": "text", "id_client": "text", "method": "text", "amount": "decimal", "paid_on": "date"}
    assert monitor.first_days == [START + timedelta(days=d) for d in range(10)]
    assert one(monitor, "check_results", "status <> 'ok'").isEmpty()
    assert one(monitor, "metrics", "`table` = 'clients' and metric = 'score'").count() == 1  # a snapshot: newest date only
    assert one(monitor, "metrics", "`table` = '_global'").count() == 10
    assert one(monitor, "loads").count() == 21


def test_tables_without_rules_get_suggested_ones(monitor):
    kinds = {(r.table, r.type) for r in monitor.rules if r.author == "suggested"}
    assert ("clients", "not_null") in kinds and ("indicators", "range") in kinds and not any(t == "payments" for t, _ in kinds)
    again = Monitor(monitor.spark, monitor.connector, monitor.store)
    assert again.rules == monitor.rules  # kept with the results


def test_nothing_new_means_no_work(monitor):
    assert monitor.sync() == []


def test_one_day_path_equals_what_was_stored(spark, gold, monitor):
    day = START + timedelta(days=9)
    tables = {s.name: monitor.store.rows(s).where(F.col("load_date") == F.lit(day)) for s in monitor.catalog.tables if s.name == "payments"}
    from loadwatch.operators.baseline import base_points
    history = base_points(monitor.store.read("metrics")).where(F.col("load_date") < F.lit(day))
    arrivals = spark.createDataFrame([(day, "payments", 1, 1)], "load_date date, table string, arrived_minute int, now_minute int")
    received = arrivals.select("load_date", "table", F.array(*map(F.lit, monitor.catalog.spec("payments").column_names)).alias("columns"))
    bands = {r.check_id: r for r in validate(monitor.catalog, tables, arrivals, received, history, one_day=True).bands.collect()}
    stored = {r.metric: r.value for r in one(monitor, "metrics", f"`table` = 'payments' and load_date = '{day}'").collect()}
    assert bands["R003"].lo == pytest.approx(stored["rule:R003:lo"]) and bands["R003"].hi == pytest.approx(stored["rule:R003:hi"])
    assert bands["rows"].value == stored["rows"] == 60


def test_duplicates_open_an_incident_with_its_run_and_a_republication_closes_it(spark, gold, monitor):
    publish(spark, gold, days=11, copied=10, published="2026-10-06T12:00:00+00:00")
    assert monitor.sync() == [START + timedelta(days=10)]
    (found,) = monitor.incidents().collect()
    assert found.run_url == "http://x/#run=run-11"
    assert found.table == "payments" and found.run_id == "run-11" and "unique" in {c.rule_type for c in found.checks}
    assert one(monitor, "loads", "`table` = 'payments'").agg(F.max("row_count")).first()[0] == 120
    monitor.escalate("payments", "ana")
    assert monitor.incidents().first().status == "escalated"
    publish(spark, gold, days=10, published="2026-10-07T12:00:00+00:00")  # earlier dates only, published again
    assert len(monitor.sync()) == 10
    (found,) = monitor.incidents().collect()
    assert found.status == "resolved" and (found.resolved_date, found.resolved_minute) >= (found.opened_date, found.opened_minute)
    dates = [r.event_date for r in monitor.timeline().orderBy("position").collect()]
    assert dates == sorted(dates)
    newest = START + timedelta(days=9)
    spec = monitor.catalog.spec("payments")
    assert monitor.store.rows(spec).where(F.col("load_date") == F.lit(newest)).count() == 60
    assert one(monitor, "check_results", f"`table` = 'payments' and load_date = '{newest}'").count() == 6


def test_a_dropped_column_fails_structure_and_its_consequences_together(spark, gold, monitor):
    publish(spark, gold, days=12, drop="amount", published="2026-10-08T12:00:00+00:00")
    monitor.sync()
    day = START + timedelta(days=11)
    got = {r.check_id: r for r in one(monitor, "check_results", f"`table` = 'payments' and load_date = '{day}'").collect()}
    assert got["structure"].status == "fail" and "amount" in got["structure"].message
    assert got["R002"].status == "ok" and got["R003"].value == 0 and got["R003"].status == "fail"
    assert monitor.incidents().where("status = 'open'").count() == 1


def test_reading_the_state(monitor):
    shots = monitor.snapshot()
    k = shots["kpis"].first()
    assert k.tables_total == 3 and k.open_incidents == 1 and k.checks_failed >= 2 and k.rows_today > 0
    assert shots["tables"].count() == 3 and shots["incidents"].count() == 2 and shots["score_series"].count() == 12
    assert not shots["events"].isEmpty() and shots["publications"].count() == 4
    detail = monitor.table_detail("payments")
    assert {"results", "volume", "scores", "heatmap", "profile", "outlier:R003"} <= set(detail)
    assert detail["profile"].count() == 5 and detail["results"].count() == 6 and detail["volume"].count() == 12
    assert detail["outlier:R003"].where("lo is not null").count() == 8 and detail["outlier:R003"].where("anomalous").count() >= 1
    lines = [r.line for r in monitor.metrics_text().orderBy("position", "label").collect()]
    assert lines[1] == "loadwatch_open_incidents 1" and any(x.startswith('loadwatch_table_rows{table="payments"} ') for x in lines)
    (mail,) = monitor.reports().collect()
    assert mail.recipient == "data@x.example" and "absent: amount" in mail.body


def test_rules_can_be_tried_changed_and_removed(monitor):
    tried = monitor.preview({"table": "payments", "type": "allowed_values", "severity": "low", "params": {"column": "method", "values": ["pse"]}})
    assert tried["status"] == "fail" and len(tried["examples"]) == 5
    before = len(monitor.rules)
    added = monitor.add_rule({"table": "payments", "type": "not_null", "severity": "low", "params": {"column": "id_client"}})
    assert not monitor.update_rule(added.id, enabled=False).enabled
    assert added.id not in {r.id for r in monitor.catalog.rules_for("payments")}
    monitor.delete_rule(added.id)
    assert len(monitor.rules) == before
    with pytest.raises(ValueError):
        monitor.update_rule("R999", enabled=False)


def test_overdue_source_is_one_incident_per_table(spark, tmp_path):
    publish(spark, tmp_path, days=3, published="2026-09-04T07:00:00+00:00")
    cfg = config(tmp_path, expected="07:00")
    cfg["tables"] = cfg["tables"][:2]
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    m.sync()
    assert not m.check_overdue(datetime(2026, 9, 5, 7, 59))
    assert m.check_overdue(datetime(2026, 9, 5, 8, 0)) and not m.check_overdue(datetime(2026, 9, 5, 9, 0))
    assert m.incidents().where("title = 'Availability of the daily table'").count() == 2
    publish(spark, tmp_path, days=4, published="2026-09-05T09:00:00+00:00")
    m.sync()
    rows = m.incidents().collect()
    assert {r.status for r in rows} == {"resolved"}
    m.resolve("payments", "late answer")
    assert m.incidents().where("resolution = 'manual'").isEmpty()  # already resolved


def test_watching_a_folder_of_manifests(spark, tmp_path):
    publish(spark, tmp_path, days=4, published="2026-09-04T23:00:00+00:00")
    cfg = config(tmp_path)
    cfg["tables"] = cfg["tables"][:1]
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    (tmp_path / "manifests").mkdir()
    for i, days in enumerate((["2026-09-01", "2026-09-02"], ["2026-09-03", "2026-09-04"])):
        (tmp_path / "manifests" / f"{i}.json").write_text(json.dumps({"run_id": f"r{i}", "published_at": f"2026-09-0{4 + i}T23:00:00", "dates": days}))
        os.utime(tmp_path / "manifests" / f"{i}.json", (1.7e9 + i, 1.7e9 + i))
    for _ in range(2):
        m.watch(str(tmp_path / "manifests"), str(tmp_path / "checkpoint")).awaitTermination()
    assert m.store.read("loads").count() == 4 and m.runs().count() == 2


def test_a_source_column_may_be_called_load_date(spark, tmp_path):
    spark.range(6).selectExpr("id", "date_add(date'2026-09-01', cast(id % 2 as int)) load_date", "id % 2 times") \
        .coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    (tmp_path / "manifest.json").write_text('{"run_id": "r", "published_at": "2026-09-02T01:00:00", "dates": ["2026-09-01", "2026-09-02"]}')
    cfg = {"source": "s", "path": str(tmp_path), "manifest": "manifest.json", "tables": [{"name": "t", "date_column": "load_date"}],
           "rules": [{"table": "t", "type": "unique", "severity": "low", "params": {"columns": ["times"]}}]}
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    assert len(m.sync()) == 2
    got = m.store.read("check_results").where("check_id = 'R001'").collect()
    assert [r.failing_rows for r in got] == [2, 2] and m.store.rows(m.catalog.spec("t")).count() == 6


def test_last_date_only_still_loads_the_history(spark, tmp_path):
    publish(spark, tmp_path, days=4, listed=["2026-09-04"])
    dates = read_manifest(spark, f"{tmp_path}/manifest.json").select(F.explode("dates").alias("load_date"))
    con = load_connector(spark, config(tmp_path))
    frames = [(con.current(spark, t)[0], con.spec(t)) for t in ("payments", "indicators", "clients")]
    none = spark.createDataFrame([], "load_date date")
    assert plan_dates(dates, available_dates(frames), none, True).count() == 4
    assert plan_dates(dates, None, none, False).count() == 1


def test_missing_files_and_candidates(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="cannot find"):
        load_connector(spark, {"source": "x", "path": str(tmp_path), "tables": [{"name": "no_such"}]})


def test_yaml_with_spanish_keys(spark, tmp_path):
    pytest.importorskip("yaml")
    spark.range(3).selectExpr("id").write.parquet(f"{tmp_path}/ventas.parquet")
    (tmp_path / "c.yaml").write_text(f"fuente: ventas\nruta: {tmp_path}\nhora_esperada: '06:30'\nresponsable: Equipo\ntablas:\n"
                                     "  - {nombre: ventas, tipo: snapshot, consumidores: [Comité]}\nreglas:\n"
                                     "  - {table: ventas, type: unico, severity: critica, params: {columns: [id]}}\n")
    con = load_connector(spark, str(tmp_path / "c.yaml"))
    spec = con.spec("ventas")
    assert (spec.expected_at, spec.owner, spec.load_type, spec.consumers) == (390, "Equipo", "snapshot", ("Comité",))
    assert con.catalog.rules[0].type == "unique" and con.auto_rules == frozenset()


def test_csv_without_manifest_is_validated_when_files_change(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("id_sale,amount,region\n" + "\n".join(f"V{i},{100 + i},{'north' if i % 2 else 'south'}" for i in range(50)))
    cfg = {"source": "sales", "path": str(tmp_path), "format": "csv", "tables": [{"name": "sales", "load_type": "snapshot"}]}
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    assert len(m.sync()) == 1 and m.sync() == []
    assert {"not_null", "range", "allowed_values"} <= {r.type for r in m.rules}
    assert m.store.read("loads").first().row_count == 50
    path.write_text("id_sale,amount,region\nV1,-5,west\n")
    os.utime(path, (1e10, 1e10))
    (day,) = m.sync()
    bad = m.store.read("check_results").where((F.col("load_date") == F.lit(day)) & (F.col("status") == "fail"))
    assert {r.rule_type for r in bad.collect()} == {"range", "allowed_values"}


def test_manifests_that_cannot_be_read_are_ignored(spark, tmp_path):
    (tmp_path / "a.json").write_text("not json at all")
    (tmp_path / "b.json").write_text('{"run_id": "r"}')
    (tmp_path / "c.json").write_text('{"run_id": "r", "published_at": "2026-10-05T12:30:00+00:00", "dates": ["2026-10-02", "2026-10-01", "x"]}')
    (r,) = read_manifest(spark, str(tmp_path)).collect()
    assert r.dates == [date(2026, 10, 1), date(2026, 10, 2)] and r.published_minute == 750
    (tmp_path / "d.json").write_text('{"published_at": "2026-10-06T01:00:00+00:00"}')
    assert read_manifest(spark, f"{tmp_path}/d.json").first().dates == [date(2026, 10, 6)]


def test_fingerprint_without_manifest_is_the_newest_file(spark, tmp_path):
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    (file,) = [f for f in os.listdir(tmp_path / "a.parquet") if f.endswith(".parquet")]
    os.utime(tmp_path / "a.parquet" / file, (1_700_000_000, 1_700_000_000))
    assert fingerprint(spark, None, [f"{tmp_path}/a.parquet"]).first()[0] == "mtime:1700000000"


def test_types_as_stored(spark):
    df = spark.createDataFrame([(True, Decimal("1.50"), float("nan"), date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5), bytearray(b"\xab"), [1, 2])],
                               "b boolean, d decimal(10,2), f double, day date, ts timestamp_ntz, bin binary, arr array<int>")
    assert tuple(normalize_types(df).first()) == (1, 1.5, None, "2026-01-02", "2026-01-02 03:04:05", "ab", "[1,2]")
    assert [c.type for c in infer_spec(df, "t").columns] == ["integer", "decimal", "decimal", "date", "date", "text", "text"]
    micro = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5, 120),)], "ts timestamp_ntz")
    assert normalize_types(micro).first()[0] == "2026-01-02 03:04:05.000120"


def test_alignment_and_nan(spark):
    df = spark.createDataFrame([(1.0, "x", True), (float("nan"), "y", False)], "v double, extra string, flag boolean")
    spec = TableSpec("t", (Field("gone", "text"), Field("v", "decimal"), Field("flag", "integer", spark_type="boolean")))
    assert [tuple(r) for r in align_to_spec(df, spec).orderBy("flag").collect()] == [(None, None, 0), (None, 1.0, 1)]


def test_rows_without_a_date_belong_to_no_load(spark):
    df = spark.createDataFrame([(1, date(2026, 1, 1)), (2, None)], "id int, day date")
    assert [r.load_date for r in tag_loads(df, infer_spec(df, "t", date_column="day")).collect()] == [date(2026, 1, 1)]
    assert tag_loads(df, infer_spec(df, "t", load_type="snapshot"), date(2026, 1, 2)).count() == 2


def test_reading_one_load_prunes_the_file(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "timestamp_ntz'2026-09-01 10:00:00' + make_interval(0, 0, 0, cast(id as int)) ts")
    df.write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    spec = infer_spec(df, "t", date_column="ts")
    load = read_load(df, spec, START)
    assert load.count() == 1 and read_load(df, spec, None).count() == 10
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in load._jdf.queryExecution().toString()
    assert read_load(df.drop("ts"), spec, START).count() == 10


def test_retention_drops_days_and_rewrites_the_edge_month(spark, tmp_path):
    store, spec = Store(spark, str(tmp_path)), TableSpec("t", (Field("id", "integer"),))
    rows = spark.range(200).selectExpr("id", "date_add(date'2026-01-01', cast(id as int)) load_date")
    store.write_load(rows, spec)
    metrics = rows.selectExpr("load_date", "'t' `table`", "'rows' metric", "cast(id as double) value")
    store.write("metrics", metrics)
    store.apply_retention([spec], date(2026, 7, 19))
    assert store.rows(spec).agg(F.min("load_date"), F.count("id")).first()[:] == (date(2026, 7, 12), 8)
    assert store.read("metrics").count() == 200  # not the first of a month
    store.apply_retention([spec], date(2026, 7, 1))
    assert store.read("metrics").agg(F.min("load_date")).first()[0] == date(2026, 3, 3)


def test_rewriting_a_day_keeps_its_neighbours_and_an_empty_day_disappears(spark, tmp_path):
    store, spec = Store(spark, str(tmp_path)), TableSpec("t", (Field("id", "integer"),))
    store.write_load(spark.sql("select 1L id, date'2026-01-01' load_date union all select 2L, date'2026-01-02'"), spec)
    store.write_load(spark.sql("select 3L id, date'2026-01-02' load_date where false"), spec, [date(2026, 1, 2)])
    assert [tuple(r) for r in store.rows(spec).collect()] == [(1, date(2026, 1, 1))]
    point = lambda t, v: spark.sql(f"select date'2026-01-01' load_date, '{t}' `table`, 'rows' metric, {v}D value")
    store.write("metrics", point("a", 1).unionAll(point("b", 2)))
    store.write("metrics", point("a", 9))
    assert {(r.table, r.value) for r in store.read("metrics").collect()} == {("a", 9.0), ("b", 2.0)}


def test_csv_schema_is_frozen_after_the_first_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    first = scan_csv(spark, f"{tmp_path}/a.csv")
    assert first.dtypes == [("a", "int"), ("b", "string")]
    (tmp_path / "a.csv").write_text("a,b\nnot a number,x\n")
    assert scan_csv(spark, f"{tmp_path}/a.csv", first.schema).first().a is None


def test_a_day_may_come_in_many_files_and_batches(spark, folder):
    """Rows of a publication add up; a later publication replaces its days; a repeated batch changes nothing."""
    from loadwatch.streaming.ingest import stream_rows
    store, spec = Store(spark, f"{folder}/store"), TableSpec("t", (Field("id", "integer"),))
    rows = spark.range(20).selectExpr("id", "date_add(date'2026-03-01', cast(id % 2 as int)) load_date", "'2026-03-02T01' published")
    rows.repartition(6).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_rows(stream, spec, store, f"{folder}/checkpoint", publication="published").awaitTermination()
    assert sorted(r.id for r in store.rows(spec).collect()) == list(range(20))
    store.add_batch(rows.where("id = 3"), spec, 99, "published")
    store.add_batch(rows.where("id = 3"), spec, 99, "published")
    assert store.rows(spec).count() == 21
    second = rows.where("id < 4").withColumn("published", F.lit("2026-03-03T01")).where("load_date = date'2026-03-02'")
    second.repartition(2).write.mode("append").parquet(f"{folder}/in")
    stream_rows(stream, spec, store, f"{folder}/checkpoint", publication="published").awaitTermination()
    got = [(r.load_date.day, r.id) for r in store.rows(spec).collect()]
    assert sorted(i for d, i in got if d == 2) == [1, 3] and sorted(i for d, i in got if d == 1) == list(range(0, 20, 2))
    store.add_batch(rows.where("id = 5"), spec, 100, "published")  # late rows of the publication that was replaced
    assert store.rows(spec).where("load_date = date'2026-03-02'").count() == 2
    store.write_load(rows.where("id = 7").drop("published"), spec)
    assert [r.id for r in store.rows(spec).where("load_date = date'2026-03-02'").collect()] == [7]


def test_every_manifest_of_a_folder_is_validated_in_order(spark, tmp_path):
    publish(spark, tmp_path, days=4, published="2026-09-04T23:00:00+00:00")
    cfg = {**config(tmp_path), "manifest": "manifests"}
    cfg["tables"] = cfg["tables"][:1]
    (tmp_path / "manifests").mkdir()
    for i, days in ((1, ["2026-09-03", "2026-09-04"]), (0, ["2026-09-01", "2026-09-02"])):
        (tmp_path / "manifests" / f"{i}.json").write_text(json.dumps({"run_id": f"r{i}", "published_at": f"2026-09-0{4 + i}T23:00:00", "dates": days, "datasets": {"payments": 120 + i}}))
    (tmp_path / "manifests" / "bad.json").write_text('{"run_id": "x", "published_at": "yesterday", "dates": ["2026-09-09"]}')
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    assert m.kpis().first().tables_total == 0 and m.snapshot()["tables"].isEmpty()  # before the first publication
    assert m.sync() == [START + timedelta(days=d) for d in range(4)] and m.sync() == []
    runs = {r.run_id: r for r in m.runs().collect()}
    assert set(runs) == {"r0", "r1"} and runs["r1"].dataset_rows == 121
    assert [r.load_date.day for r in m.store.read("publications").orderBy("seq", "load_date").collect()] == [1, 2, 3, 4]


def test_tables_that_start_later_get_rules_from_their_own_first_load(spark, tmp_path):
    for name, first in (("a", 0), ("b", 2)):
        spark.range(200).selectExpr("id row_id", "abs(hash(id)) % 50 + 0.5D amount", f"date_add(date'2026-09-01', cast({first} + id % {5 - first} as int)) day") \
            .coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "manifest.json").write_text('{"run_id": "r", "published_at": "2026-09-05T23:00:00", "dates": ["2026-09-05"]}')
    cfg = {"source": "s", "path": str(tmp_path), "manifest": "manifest.json", "expected_at": "23:59",
           "tables": [{"name": n, "date_column": "day"} for n in ("a", "b")]}
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    m.sync()
    kinds = {t: sorted(r.type for r in m.rules if r.table == t) for t in ("a", "b")}
    assert kinds["a"] == kinds["b"] == ["not_null", "range", "unique"]
    judged = m.store.read("check_results").where("kind = 'rule' and `table` = 'b'").groupBy("load_date").count().collect()
    assert {r.load_date.day: r["count"] for r in judged}[3] == 3


def test_a_rule_that_fails_on_the_data_is_found_without_the_others(spark, tmp_path):
    """Only the table with the broken condition is read again, and what is said is the cause."""
    from loadwatch.model import Catalog, Rule
    from loadwatch.plans.validate import collect_stats
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(40).selectExpr("id", "concat('x', id) name", "date'2026-09-01' load_date")
    df.write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    spec_p, spec_q = infer_spec(p.drop("load_date"), "p"), TableSpec("q", (Field("id", "integer"),))
    count = F.udf(lambda x: (seen.add(1), x)[1], "bigint").asNondeterministic()
    q = df.select(count("id").alias("id"), "load_date")
    sql = lambda t, i, c: Rule(i, t, "sql", "low", {"condition": c})
    rules = (sql("p", "R1", "id < 5"), sql("p", "R2", "cast(name as int) > 0"), sql("p", "R3", "id > 35"),
             Rule("R4", "q", "range", "low", {"column": "id", "min": 3}))
    stats, reasons = collect_stats(Catalog((spec_p, spec_q), rules), {"p": p, "q": q})
    got = {(r.table, r.check_id): r.failing_rows for r in stats.where("kind = 'row'").collect()}
    assert got == {("p", "R1"): 5, ("p", "R3"): 4, ("q", "R4"): 3}
    assert set(reasons["p"]) == {"R2"} and "CAST_INVALID_INPUT" in reasons["p"]["R2"] and not reasons["q"]
    assert seen.value == 40  # the other table was evaluated once


def test_a_column_with_another_type_is_cast_to_the_contract(spark):
    spec = TableSpec("t", (Field("id", "integer", spark_type="bigint"), Field("v", "decimal", spark_type="double"), Field("f", "integer", spark_type="boolean")))
    df = spark.createDataFrame([("7", "1.5", "true"), ("x", "NaN", "maybe")], "id string, v string, f string")
    assert [tuple(r) for r in align_to_spec(df, spec).collect()] == [(7, 1.5, 1), (None, None, None)]


def test_retention_prunes_when_any_validated_day_is_a_first(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("metrics", spark.range(426).selectExpr("date_add(date'2025-01-01', cast(id as int)) load_date", "'t' `table`", "'rows' metric", "1D value"))
    store.apply_retention([], date(2026, 3, 2), validated=[date(2026, 3, 1), date(2026, 3, 2)])
    assert store.read("metrics").agg(F.min("load_date")).first()[0] == date(2025, 11, 1)
    text = store.read("metrics", date(2026, 2, 1), date(2026, 2, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_month" in text and store.read("metrics", date(2026, 2, 1), date(2026, 2, 3)).count() == 3


def test_rules_are_kept_as_versions_and_only_when_they_change(spark, folder):
    from loadwatch.model import Rule
    from loadwatch.sources.rulebook import keep_rules, kept_rules
    rules = [Rule("R001", "t", "not_null", "low", {"column": "c"})]
    assert kept_rules(spark, f"{folder}/rules") is None
    for _ in range(2):
        keep_rules(spark, rules, f"{folder}/rules")
    assert os.listdir(f"{folder}/rules") == ["version=1"] and kept_rules(spark, f"{folder}/rules") == rules
    for i in range(2, 9):
        rules.append(Rule(f"R{i:03d}", "t", "not_null", "low", {"column": "c"}))
        keep_rules(spark, rules, f"{folder}/rules")
    os.makedirs(f"{folder}/rules/version=9")  # a write that never ended
    assert kept_rules(spark, f"{folder}/rules") == rules and len(os.listdir(f"{folder}/rules")) == 6


def test_staged_tables_go_when_a_sync_ends(spark, tmp_path):
    publish(spark, tmp_path, days=2, copied=1)
    cfg = config(tmp_path)
    cfg["tables"] = cfg["tables"][:1]
    shared = spark.conf.get("spark.checkpoint.dir")
    m = Monitor(spark, load_connector(spark, cfg), Store(spark, str(tmp_path / "store")))
    before = set(os.listdir(shared))
    m.sync()
    assert set(os.listdir(shared)) == before
    (mail,) = m.reports().collect()
    assert "id_payment=P-1-0 (x2)" in mail.body  # the repeated keys travel with the message


def test_dialects_are_told_by_their_first_lines():
    from loadwatch.sources.dialect import Dialect, dialect_of
    assert dialect_of(["a,b", "1,x", "2,y"]) == Dialect()
    assert dialect_of([]) == Dialect() and dialect_of(["only", "1"]) == Dialect()
    assert dialect_of(["a;b;c", "1.234,5;x, y;31/01/2026", "7;z;01/02/2026"]) == Dialect(";", '"', frozenset({"a"}), {"c": "d/M/yyyy"})
    assert dialect_of(["a\tb", "1\t01-31-2026"]) == Dialect("\t", '"', frozenset(), {"b": "M-d-yyyy"})
    assert dialect_of(["a|b", "'x|y'|2", "'z|z'|3"]) == Dialect("|", "'")
    assert dialect_of(["d;v", "01/02/2026;1"]).dates == {"d": "d/M/yyyy"} and dialect_of(["d,v", "01/02/2026,1"]).dates == {"d": "M/d/yyyy"}
    assert dialect_of(["d,v", "2026-01-02,1.5"]).converted == set()


def test_a_dialect_is_kept_for_later_loads(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("id;amount;day\n1;1.500,25;31/01/2026\n2;-7,5;01/02/2026\n3;;\n")
    cfg = {"source": "s", "path": str(tmp_path), "format": "csv", "tables": [{"name": "sales", "load_type": "snapshot"}]}
    con = load_connector(spark, cfg)
    assert [(c.name, c.type) for c in con.spec("sales").columns] == [("id", "integer"), ("amount", "decimal"), ("day", "date")]
    df, columns = con.current(spark, "sales")
    assert columns == ["id", "amount", "day"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1500.25, date(2026, 1, 31)), (2, -7.5, date(2026, 2, 1)), (3, None, None)]
    (tmp_path / "sales.csv").write_text("id;amount;extra\n4;3,5;x\n5;wrong;y\n")
    df, columns = con.current(spark, "sales")
    assert columns == ["id", "amount", "extra"] and [tuple(r) for r in df.orderBy("id").collect()] == [(4, 3.5, "x"), (5, None, "y")]
