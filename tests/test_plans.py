"""Plans that must hold at any size: scans, pruning, map-side work, no all-pairs joins."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loadwatch.model import Catalog, Rule, specs_frame
from loadwatch.operators import incidents as inc
from loadwatch.operators.baseline import replay, score_new_loads
from loadwatch.operators.evaluate import daily_stats, duplicate_examples, evaluate_rules, failing_examples
from loadwatch.operators.profile import profile
from loadwatch.operators.rules import validate_rule
from loadwatch.sources.connector import align_to_spec, infer_spec, scan_parquet, tag_loads

POINTS = "table string, check_id string, load_date date, value double, z double, same_weekday boolean, volume boolean"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Nine columns over 40 days; a third of the rows on one day, and a third of them the same key."""
    path = str(tmp_path_factory.mktemp("wide") / "t.parquet")
    spark.range(9000).selectExpr(
        "if(id % 3 = 0, 0, id) id", "date_add(date'2026-01-01', if(id % 3 = 1, 7, cast(id % 40 as int))) day", "cast(id as double) amount",
        "id % 5 kind", "concat('long text ', id % 700) note", "id a", "id b", "id c", "id d").write.parquet(path)
    df = scan_parquet(spark, path)
    spec = infer_spec(df, "t", date_column="day")
    rules = [validate_rule(Rule(i, "t", k, "high", p), Catalog((spec,))) for i, k, p in (
        ("R1", "range", {"column": "amount", "max": 8000}), ("R2", "not_null", {"column": "note"}),
        ("R3", "allowed_values", {"column": "kind", "values": [0, 1, 2, 3]}), ("R4", "outlier", {"column": "amount", "aggregate": "sum"}),
        ("R5", "unique", {"columns": ["id"]}), ("R6", "unique", {"columns": ["note"]}))]
    return align_to_spec(tag_loads(df, spec), spec), spec, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_pairs(text):
    return "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_all_row_rules_and_aggregates_share_one_pruned_scan(table):
    df, spec, rules = table
    text = plan(daily_stats(df, spec, rules[:4]))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning(load_date") == 1
    assert "partial_count" in text and "partial_sum" in text
    assert "ReadSchema: struct<day:date,amount:double,kind:bigint,note:string>" in text


def test_uniqueness_combines_copies_before_the_shuffle(table):
    df, spec, rules = table
    text = plan(daily_stats(df, spec, rules[4:5]))
    before_shuffle = text.split("Exchange hashpartitioning(load_date")[-1]
    assert "partial_count" in before_shuffle and no_pairs(text)


def test_free_text_is_scanned_once_and_never_shuffled(table):
    df, spec, rules = table
    text = plan(daily_stats(df, spec, rules[5:6]))
    assert text.count("FileScan") == 2 and text.count("note:string") == 1  # the row count reads the day alone
    assert "sha2" in text and "Join" not in text and no_pairs(text)
    assert not [x for x in text.split("\n") if "Exchange" in x and "note#" in x]


def test_a_third_of_the_rows_in_one_key_or_day_is_counted_whole(table):
    df, spec, rules = table
    got = {(r.load_date, r.check_id): r for r in evaluate_rules(df, spec, [rules[0], rules[4], rules[5]]).collect()}
    assert sum(r.total_rows for (_, c), r in got.items() if c == "R1") == 9000
    hot = df.where(F.col("load_date") == F.lit(date(2026, 1, 8)))
    for rule, keys in (("R5", ["id"]), ("R6", ["note"])):
        assert got[date(2026, 1, 8), rule].failing_rows == hot.count() - hot.select(*keys).distinct().count()


def test_examples_are_cut_before_the_shuffle(table):
    df, spec, rules = table
    for text in (plan(failing_examples(df, spec, rules[:3])), plan(duplicate_examples(df, spec, rules[4]))):
        assert "WindowGroupLimit" in text and "Partial" in text and no_pairs(text)


def test_the_exact_profile_shuffles_narrow_pairs(table):
    df, spec, _ = table
    text = plan(profile(df, spec))
    assert "Expand" not in text and "sha2" in text and "partial_count" in text and no_pairs(text)


def test_expected_rows_read_each_point_once(spark):
    """A day of every point asked: as many rows reach the windows as there are points and days, not their pairs."""
    days = spark.range(400).selectExpr("'t' `table`", "'a' check_id", "date_add(date'2025-01-01', cast(id as int)) load_date", "1.0D value", "3.0D z", "true same_weekday", "true volume")
    text = plan(score_new_loads(days.select("table", "check_id", "load_date", "value"), days))
    assert [x for x in text.split("\n") if "Join" in x and "LeftSemi" not in x] == [] and text.count("Window [") == 2
    assert score_new_loads(days.select("table", "check_id", "load_date", "value"), days).where("center is not null").count() > 300


def test_new_days_need_no_python(spark):
    today = spark.createDataFrame([("t", "a", date(2026, 1, 8), 1.0, 3.0, True, True)], POINTS)
    history = today.select("table", "check_id", "load_date", "value")
    text = plan(score_new_loads(history, today))
    assert "Pandas" not in text and "Python" not in text and no_pairs(text)
    assert "FlatMapGroupsInPandas" in plan(replay(today))


def test_incidents_shuffle_by_table_only_once(spark):
    obs = spark.createDataFrame([], inc.OBSERVATION_SCHEMA)
    text = plan(inc._facts(inc._stream(obs, None)))
    assert text.count("Exchange") == 1 and "hashpartitioning(table" in text


def test_configuration_frames_have_a_known_size(spark, table):
    _, spec, _ = table
    frame = specs_frame(spark, Catalog((spec,)))
    assert "LocalTableScan" in plan(frame)
    assert frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000
