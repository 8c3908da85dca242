"""Profiles that add up: merged sketches against the rows they stand for."""
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loadwatch.model import Field, TableSpec
from loadwatch.operators.sketches import load_sketches, merged_profile
from loadwatch.plans.monitor import Monitor
from loadwatch.sources.connector import load_connector
from loadwatch.sources.publications import parse_manifest
from loadwatch.sources.store import Store

START = date(2026, 3, 30)
SPEC = TableSpec("t", (Field("id", "integer"), Field("word", "text"), Field("amount", "decimal"), Field("gone", "decimal")))


def rows(spark, n=20000, days=4):
    """A hot word in half of the rows, empty texts, nulls, NaN and both zeros; a column without values."""
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 11 = 0 THEN '' WHEN id % 13 != 0 THEN concat('w', id % 3000) END AS word",
        "CASE id % 100 WHEN 0 THEN DOUBLE('NaN') WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D WHEN 3 THEN NULL ELSE id % 1000 + 0.5D END AS amount",
        "CAST(NULL AS DOUBLE) AS gone", f"date_add(DATE'{START}', CAST(id % {days} AS INT)) AS load_date")


def test_merged_loads_equal_the_rows_together(spark):
    df = rows(spark)
    got = {r.column: r for r in merged_profile(load_sketches(df, SPEC)).collect()}
    pdf = df.toPandas()
    assert [got[c].position for c in ("id", "word", "amount", "gone")] == [0, 1, 2, 3] and {r.loads for r in got.values()} == {4}
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in got]).first()
    assert all(got[c].null_pct == round(100 * nulls[c] / 20000, 2) and got[c].n == 20000 for c in got)
    distinct = df.agg(*[F.count_distinct(F.col(c) if c != "amount" else F.col(c) + F.lit(0.0)).alias(c) for c in got]).first()
    assert all(abs(got[c].distinct_values - distinct[c]) <= 4 * 0.016 * distinct[c] for c in got) and distinct["word"] > 1000
    amount = pdf.amount.dropna()
    assert (got["amount"].min_value, got["amount"].max_value) == (0.0, 999.5) and got["amount"].mean_value == pytest.approx(amount.mean(), abs=0.01)
    for share, q in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95")):
        x = got["amount"][q]
        assert (amount <= x).mean() >= share - 0.02 and (amount < x).mean() <= share + 0.02
    none = got["gone"]
    assert (none.distinct_values, none.null_pct, none.min_value, none.mean_value, none.median) == (0, 100.0, None, None, None)
    assert got["word"].median is None and got["word"].max_value is None


def test_periods_and_no_loads(spark):
    made = load_sketches(rows(spark), SPEC)
    by = merged_profile(made, "date_format(load_date, 'yyyy-MM') AS month").where("column = 'id'").orderBy("month").collect()
    assert [(r.month, r.loads, r.n) for r in by] == [("2026-03", 2, 10000), ("2026-04", 2, 10000)]
    assert load_sketches(rows(spark).limit(0), SPEC).isEmpty() and merged_profile(made.limit(0)).isEmpty()


def test_one_row_a_task_and_day_is_shuffled(spark):
    plan = load_sketches(rows(spark), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(load_date" in plan


def test_profiles_outlive_the_rows_and_follow_republications(spark, folder):
    def publish(days, at):
        rows(spark, 400 * days, days).withColumnRenamed("load_date", "day").write.mode("overwrite").parquet(f"{folder}/t.parquet")
        dates = [str(START + timedelta(days=d)) for d in range(days)]
        return parse_manifest(spark.createDataFrame([("run", f"2026-05-0{at}T06:00:00", dates, None)],
                                                    "run_id string, published_at string, dates array<string>, datasets map<string,bigint>"))

    con = load_connector(spark, {"source": "s", "path": folder, "expected_at": "07:00", "tables": [{"name": "t", "date_column": "day"}], "rules": []}) \
        if publish(4, 1) is not None else None
    m = Monitor(spark, con, Store(spark, folder + "/store"), row_days=1, sketches=True)
    m.sync(publish(4, 1))
    spec = m.catalog.spec("t")
    assert m.store.rows(spec).select("load_date").distinct().count() == 2  # retention
    assert {(r.loads, r.n) for r in m.profile_between("t").collect()} == {(4, 1600)}
    one = m.profile_between("t", START + timedelta(days=1), START + timedelta(days=2)).where("column = 'id'").first()
    assert (one.loads, one.n) == (2, 800)
    plan = m.profile_between("t")._jdf.queryExecution().executedPlan().toString()
    assert "/store/rows" not in plan and f"{folder}/t.parquet" not in plan
    assert len(m.sync(publish(2, 2))) == 2  # two days come again
    assert {(r.loads, r.n) for r in m.profile_between("t").collect()} == {(4, 1600)}
    m.sketches = False  # a day that comes again without a profile has none
    m.sync(publish(1, 3))
    assert {(r.loads, r.n) for r in m.profile_between("t").collect()} == {(3, 1200)}
