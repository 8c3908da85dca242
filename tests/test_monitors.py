from datetime import date, datetime

import pytest

from loadwatch.functions.scalars import evidence_number, grade, hhmm, locale_number, run_url
from loadwatch.model import Catalog, Field, TableSpec, specs_frame
from loadwatch.operators.monitors import availability, due_loads, missing_loads, overdue_source, structure, table_status
from loadwatch.operators.profile import profile, segment_indicators, suggest_rules
from loadwatch.operators.score import global_scores, table_scores, unchecked_score
from pyspark.sql import functions as F

DAY = date(2026, 10, 5)
COLUMNS = tuple(Field(n, "text") for n in ("id", "amount", "channel"))
ARRIVALS = "load_date date, table string, arrived_minute int, now_minute int"


@pytest.fixture(scope="module")
def specs(spark):
    return specs_frame(spark, Catalog((TableSpec("payments", COLUMNS, expected_at=420), TableSpec("rates", COLUMNS, expected_at=450, load_type="snapshot"))))


@pytest.mark.parametrize("arrived,now,status,value", [
    (430, 435, "ok", 10), (415, 430, "ok", 0), (480, 480, "ok", 60), (481, 481, "warn", 61), (540, 540, "warn", 120), (None, 495, "fail", 75)])
def test_lateness(spark, specs, arrived, now, status, value):
    r = availability(spark.createDataFrame([(DAY, "payments", arrived, now)], ARRIVALS), specs).first()
    assert (r.status, r.value, r.threshold) == (status, value, "by 08:00")


def test_backfills_are_not_late_and_daily_publications_are(spark, specs):
    rows = [(DAY, "payments", 720, 720, datetime(2026, 10, 6, 12)), (date(2026, 10, 1), "payments", 720, 720, datetime(2026, 10, 6, 12))]
    got = {r.load_date: r for r in availability(spark.createDataFrame(rows, ARRIVALS + ", published timestamp"), specs).collect()}
    assert got[DAY].status == "warn" and got[date(2026, 10, 1)].status == "ok" and got[date(2026, 10, 1)].value == 0


@pytest.mark.parametrize("columns,status,value", [
    (["channel", "id", "amount"], "ok", 0), (["id", "amount", "channel", "new"], "warn", 1), (["id", "amount"], "fail", 1), (["id", "new"], "fail", 3)])
def test_structure(spark, specs, columns, status, value):
    r = structure(spark.createDataFrame([(DAY, "payments", columns)], "load_date date, table string, columns array<string>"), specs).first()
    assert (r.status, r.value) == (status, value)


@pytest.mark.parametrize("now,status", [(419, "waiting"), (420, "delayed"), (479, "delayed"), (480, "missing")])
def test_status_before_arrival(spark, specs, now, status):
    assert table_status(spark.createDataFrame([(DAY, "payments", None, now)], ARRIVALS), specs).first().status == status


CHECKS = "load_date date, table string, check_id string, severity string, status string"


def test_status_and_score_after_arrival(spark, specs):
    checks = spark.createDataFrame([(DAY, "payments", "a", "critical", "ok"), (DAY, "payments", "b", "low", "error"),
                                    (DAY, "rates", "a", "high", "warn"), (DAY, "rates", "b", "high", "ok")], CHECKS)
    arrived = spark.createDataFrame([(DAY, "payments", 420, 430), (DAY, "rates", 420, 430)], ARRIVALS)
    assert {r.table: r.status for r in table_status(arrived, specs, checks).collect()} == {"payments": "warn", "rates": "warn"}
    missing = spark.createDataFrame([(DAY, "late")], "load_date date, table string")
    scores = table_scores(checks, missing)
    assert {r.table: r.score for r in scores.collect()} == {"payments": 80.0, "rates": 75.0, "late": 0.0}
    assert global_scores(scores).first().score == pytest.approx(155 / 3)
    bare = spark.createDataFrame([(DAY, "bare")], "load_date date, table string")
    assert unchecked_score(bare, scores).first().score == 100.0


def test_scores_round_half_to_even(spark):
    rows = [(DAY, "t", str(i), "critical", "ok" if i < 9 else "fail") for i in range(16)]
    assert table_scores(spark.createDataFrame(rows, CHECKS)).first().score == 56.2  # 56.25


def test_missing_and_due_loads(spark, specs):
    days = spark.createDataFrame([(DAY,), (date(2026, 10, 6),)], "load_date date")
    loads = spark.createDataFrame([(DAY, "payments"), (DAY, "rates"), (date(2026, 10, 6), "rates")], "load_date date, table string")
    assert [tuple(r) for r in missing_loads(specs, days, loads).collect()] == [(date(2026, 10, 6), "payments")]
    assert {tuple(r) for r in due_loads(loads, specs).collect()} == {(DAY, "payments"), (date(2026, 10, 6), "rates")}


def test_overdue_source(spark, specs):
    published = spark.createDataFrame([(datetime(2026, 10, 4, 7),)], "published timestamp")
    late = lambda h, m: {r.table for r in overdue_source(published, specs, datetime(2026, 10, 5, h, m)).collect()}
    assert late(7, 59) == set() and late(8, 0) == {"payments"} and late(8, 30) == {"payments", "rates"}
    assert overdue_source(published, specs, datetime(2026, 10, 4, 23, 59)).isEmpty()
    assert overdue_source(published.where("false"), specs, datetime(2026, 10, 5, 23, 0)).isEmpty()


def test_formats(spark):
    row = spark.range(1).select(
        hhmm(F.lit(425)).alias("a"), locale_number(F.lit(-7.73)).alias("b"), locale_number(F.lit(48159795968.0)).alias("c"),
        locale_number(F.lit(1234.56)).alias("d"), evidence_number(F.lit(1234.56)).alias("e"), evidence_number(F.lit(None)).alias("f"),
        locale_number(F.lit(None)).alias("g"), run_url("http://x/#run={run_id}", F.lit("a b/c~*")).alias("h"), run_url("", F.lit("a")).alias("i")).first()
    assert tuple(row) == ("07:05", "-7,73", "48.159.795.968", "1.235", "1.234,56", "NULL", "—", "http://x/#run=a%20b%2Fc~%2A", None)


def test_grades(spark):
    days = spark.createDataFrame([(d,) for d in (0, 30, 31, 60, 90, 91, 180, 181)], "d int")
    assert [r[0] for r in days.orderBy("d").select(grade(F.col("d"))).collect()] == list("AABBCDDE")


def test_segments_keep_empty_ones(spark):
    facts = spark.createDataFrame([("a", 100.0, 40), ("a", 300.0, 30)], "s string, amount double, late int")
    got = {r.s: tuple(r)[1:] for r in segment_indicators(facts, spark.createDataFrame([("a",), ("b",)], "s string"), "s", "amount", "late").collect()}
    assert got == {"a": (2, 400.0, 100.0, 25.0), "b": (0, 0.0, 0.0, 0.0)}


SUGGEST = TableSpec("sales", (Field("id_sale", "text"), Field("amount", "decimal"), Field("region", "text"), Field("note", "text"), Field("id_shop", "integer")))


def test_suggestions(spark):
    df = spark.range(50).selectExpr("concat('V', id) id_sale", "100.0D + id amount", "if(id % 2 = 0, 'north', 'south') region",
                                    "if(id < 25, '', 'x') note", "if(id = 3, null, id) id_shop")
    got = [(r["type"], r["params"]) for r in suggest_rules(df, SUGGEST)]
    assert got == [("not_null", {"column": "id_sale"}), ("unique", {"columns": ["id_sale"]}), ("range", {"column": "amount", "min": 0}),
                   ("allowed_values", {"column": "region", "values": ["north", "south"]})]
    assert suggest_rules(df.where("false"), SUGGEST) == []
    assert not any(r["type"] == "unique" for r in suggest_rules(df, TableSpec("s", SUGGEST.columns, load_type="snapshot")))


@pytest.mark.parametrize("n,found", [(1, False), (2, True), (12, True), (13, False)])
def test_short_catalogues_are_exact(spark, n, found):
    df = spark.range(3000).selectExpr(f"concat('value-', id % {n}) region")
    assert any(r["type"] == "allowed_values" for r in suggest_rules(df, TableSpec("s", (Field("region", "text"),)))) == found


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (None, None), (2, "a")], "n int, s string").withColumn("load_date", F.lit(DAY))
    spec = TableSpec("t", (Field("n", "integer"), Field("s", "text")))
    for exact in (True, False):
        n, s = profile(df, spec, exact).orderBy("position").collect()
        assert (n.null_pct, n.distinct_values, n.min_value, n.max_value, n.mean_value) == (25.0, 2, 1.0, 2.0, 1.67)
        assert (s.null_pct, s.distinct_values, s.min_value) == (25.0, 2, None)
