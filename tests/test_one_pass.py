"""How often a load is read: rules measured by the write, uniqueness in one scan, conditions over other tables."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from loadwatch.model import Catalog, Field, Rule, TableSpec
from loadwatch.operators import evaluate
from loadwatch.operators.evaluate import Observed, daily_stats, duplicate_examples, visible
from loadwatch.operators.rules import validate_rule
from loadwatch.plans.monitor import Monitor
from loadwatch.sources.connector import load_connector
from loadwatch.sources.publications import parse_manifest
from loadwatch.sources.store import Store

SPEC = TableSpec("t", (Field("id", "integer"), Field("word", "text"), Field("amount", "decimal"), Field("kind", "text")))
DAY = date(2026, 3, 2)


def rule(i, kind, table="t", **params):
    return validate_rule(Rule(i, table, kind, "high", params), Catalog((SPEC, TableSpec("other", SPEC.columns))))


def manifest(spark, dates):
    at = f"{dates[-1]}T06:00:00"
    return parse_manifest(spark.createDataFrame([("run", at, [str(d) for d in dates], None)],
                                                "run_id string, published_at string, dates array<string>, datasets map<string,bigint>"))


@pytest.fixture
def rows(spark):
    data = [(i, f"w{i % 7}", float(i % 11) if i % 5 else None, "ab"[i % 2]) for i in range(400)]
    return spark.createDataFrame(data, "id bigint, word string, amount double, kind string").repartition(3).withColumn("load_date", F.lit(DAY))


RULES = [rule("A", "not_null", column="amount"), rule("B", "range", column="amount", max=9), rule("C", "outlier", column="amount", aggregate="sum"),
         rule("D", "outlier", aggregate="count", column="id"), rule("U", "unique", columns=["word"]), rule("V", "unique", columns=["id"]),
         rule("W", "unique", columns=["kind", "amount"]), rule("S", "sql", condition="amount > 5"), rule("Z", "sql", condition="amount < 0")]


def test_observed_rows_give_the_fused_statistics(spark, rows, folder):
    for df in (rows, rows.limit(0)):
        seen = Observed(df, SPEC, RULES)
        seen.rows.select(df.columns).write.mode("overwrite").parquet(folder + "/x")
        want = daily_stats(rows, SPEC, [r for r in RULES if r.id in "ABCD"]).collect() if df is rows else []
        got = seen.stats(spark, DAY).collect()
        assert len(got) == 5 and (df is not rows or sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str))
        assert df is rows or all(r.total_rows == 0 and not r.value for r in got)


def test_unique_rules_share_a_scan_and_a_shuffle(spark, rows, folder):
    rows.write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    unique = [r for r in RULES if r.type == "unique"]
    plan = evaluate._unique_stats(df, SPEC, unique)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and plan.count("__key") > 0  # keys, then one row per rule and day
    got = {r.check_id: (r.failing_rows, r.repeated_groups, r.total_rows) for r in evaluate._unique_stats(df, SPEC, unique).collect()}
    for r in unique:
        counts = [x["count"] for x in df.groupBy(*r.params["columns"]).count().collect()]
        assert got[r.id] == (sum(c - 1 for c in counts), sum(c > 1 for c in counts), 400)


def test_ties_are_cut_before_the_shuffle(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("id"), F.concat(F.lit("x"), F.col("id") % 2000).alias("word"), F.lit(1.0).alias("amount"),
                                  F.lit("k").alias("kind"), F.date_add(F.lit(DAY), (F.col("id") % 1).cast("int")).alias("load_date"))
    for columns in (["id"], ["word"]):
        top = duplicate_examples(df, SPEC, rule("U", "unique", columns=columns), 3)
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "row_number" in plan
        want = sorted((str(i) if columns == ["id"] else f"x{i}") for i in range(2000)) if columns == ["word"] else [str(i) for i in range(3)]
        assert [str(r[columns[0]]) for r in top.orderBy("position").collect()] == want[:3]


@pytest.fixture
def source(spark, folder, rows):
    rows.drop("load_date").write.parquet(folder + "/t.parquet")
    rows.drop("load_date").where("id % 3 = 0").write.parquet(folder + "/other.parquet")
    rules = [{"id": r.id, "table": "t", "type": r.type, "severity": r.severity, "params": r.params} for r in RULES]
    rules += [{"id": "X", "table": "t", "type": "sql", "severity": "low", "params": {"condition": "id NOT IN (SELECT id FROM other)"}},
              {"id": "Y", "table": "other", "type": "sql", "severity": "low", "params": {"condition": "word IN (SELECT word FROM t_t WHERE amount > 9)"}}]
    con = load_connector(spark, {"source": "s", "path": folder, "expected_at": "07:00", "rules": rules,
                                 "tables": [{"name": n, "load_type": "snapshot"} for n in ("t", "other")]})
    return Monitor(spark, con, Store(spark, folder + "/store"))


def executions(spark):
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [listed.apply(i) for i in range(listed.size())]


def test_a_day_is_read_once_from_its_source(spark, source, folder):
    before = {e.executionId() for e in executions(spark)}
    source.sync(manifest(spark, [DAY]))
    plans = [e.physicalPlanDescription() for e in executions(spark) if e.executionId() not in before]
    assert plans and sum(p.count(f"{folder}/t.parquet]") for p in plans) == 1  # the write
    stored = [p for p in plans if f"{folder}/store/rows/t]" in p and "FileScan" not in p.split("\n")[0]]
    got = {(r.table, r.check_id): r for r in source.store.read("check_results").collect()}
    n = {k: sum(1 for i in range(400) if f(i, None if i % 5 == 0 else i % 11)) for k, f in {
        "A": lambda i, a: a is None, "B": lambda i, a: a is not None and a > 9, "S": lambda i, a: a is not None and a > 5, "X": lambda i, a: i % 3 != 0}.items()}
    assert {k: got["t", k].failing_rows for k in n} == n and got["t", "Z"].failing_rows == 0 and stored
    words = {f"w{i % 7}" for i in range(400) if i % 5 and i % 11 > 9}
    assert got["other", "Y"].failing_rows == sum(1 for i in range(0, 400, 3) if f"w{i % 7}" in words)
    assert got["t", "U"].failing_rows == 393 and got["t", "C"].value == sum(i % 11 for i in range(400) if i % 5) and got["t", "volume"].total_rows == 400
    kept = source.store.read("examples").where("check_id = 'X'").collect()
    assert len(kept) == 5 and all("id=" in r.shown for r in kept)
    tried = source.preview({"table": "t", "type": "sql", "severity": "low", "params": {"condition": "id IN (SELECT id FROM other)"}})
    assert tried["status"] == "fail" and tried["failing_rows"] == 134


def test_conditions_share_one_scan_unless_one_is_slow(spark, rows, monkeypatch):
    tries = []
    real = evaluate.within_budget
    monkeypatch.setattr(evaluate, "within_budget", lambda s, action, seconds: tries.append(seconds) or real(s, action, seconds))
    own = [rule(f"S{i}", "sql", condition=f"id % {i + 2} = 0") for i in range(6)]

    def stats_of(some):
        return daily_stats(rows, SPEC, some).where("kind = 'row'")

    done, reasons = evaluate.budgeted_sql_stats(spark, stats_of, own, 60)
    assert len(tries) == len(done) == 1 and not reasons
    bad = rule("S9", "sql", condition="cast(word as int) = 1")
    done, reasons = evaluate.budgeted_sql_stats(spark, stats_of, [*own, bad], 60)
    assert set(reasons) == {"S9"} and sorted(r.check_id for d in done for r in d.collect()) == sorted(r.id for r in own)


def test_views_of_the_same_name_are_put_back(spark, rows):
    spark.range(3).createOrReplaceTempView("t")
    with visible(spark, {"t": rows}, DAY):
        assert spark.table("t").count() == 400 and spark.table("t_t").count() == 400
    assert spark.table("t").count() == 3 and not spark.catalog.tableExists("t_t")
    with visible(spark, {"t": rows}, date(2026, 3, 3)):
        assert spark.table("t").count() == 0
    spark.catalog.dropTempView("t")
