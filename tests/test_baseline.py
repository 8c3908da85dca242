import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from loadwatch.operators.baseline import (CleanHistory, base_points, clean_history, expected_rows, metrics_of, replay,
                                          score_new_loads, volume_results)

MONDAY = date(2026, 10, 5)
SCHEMA = "table string, check_id string, load_date date, value double, z double, same_weekday boolean, volume boolean"


def by_hand(points, z, same_weekday, volume):
    """The definition, spelled out with the statistics module: one verdict per point."""
    clean, out = [], []
    for day, value in sorted(points):
        past = clean[-60:]
        typical = statistics.median([v for _, v in past]) if volume and past else 0
        few = volume and typical < 30
        weekday = same_weekday and not few
        sample = [v for d, v in past if d.weekday() == day.weekday()][-6:] if weekday else [v for _, v in past][-14:]
        passed = True
        band = None
        if len(sample) >= 4:
            center = statistics.median(sample)
            mad = statistics.median(abs(v - center) for v in sample)
            least = max(1.0, typical**0.5) if volume else 0
            spread = max(statistics.stdev(sample), 1.4826 * mad, 0.05 * abs(center), least, 1e-9)
            lo, hi = center - z * spread, center + z * spread
            if volume:
                lo = max(lo, 0)
                if few:
                    lo, hi = 0, max(hi, 3 * center, 30)
                passed = lo <= value <= hi
            else:
                passed = abs(value - center) / spread <= z
            band = (lo, hi)
        if passed:
            clean.append((day, value))
        out.append((day, band, passed))
    return out


def random_series(seed, days=150):
    rng = random.Random(seed)
    level = rng.choice([2, 25, 40, 700])
    return [(MONDAY + timedelta(days=i), float(max(0, round(rng.gauss(level, level * 0.2) * rng.choice([1, 1, 1, 1, 1, 1, 0, 3])))))
            for i in range(days)]


@pytest.fixture(scope="module")
def series(spark):
    rows, expected = [], {}
    for seed in range(12):
        z, weekday, volume = [(3.5, True, True), (3.5, False, True), (2.0, True, False), (3.0, False, False)][seed % 4]
        points = random_series(seed)
        expected[f"s{seed}"] = by_hand(points, z, weekday, volume)
        rows += [("t", f"s{seed}", d, v, z, weekday, volume) for d, v in points]
    return spark.createDataFrame(rows, SCHEMA).cache(), expected


def test_replay_follows_the_definition(series):
    df, expected = series
    got = {(r.check_id, r.load_date): r for r in replay(df).collect()}
    assert len(got) == df.count()
    assert sum(not p for v in expected.values() for _, _, p in v) > 50
    for key, verdicts in expected.items():
        for day, band, passed in verdicts:
            r = got[key, day]
            assert r.passed == passed
            assert (r.lo is None) == (band is None)
            if band:
                assert (r.lo, r.hi) == pytest.approx(band)


def test_new_days_without_python_equal_the_replay(series):
    df, _ = series
    bands = replay(df).cache()
    clean = bands.where("passed").select("table", "check_id", "load_date", "value")
    a = {(r.check_id, r.load_date): r for r in bands.collect()}
    for r in score_new_loads(clean, df).collect():
        b = a[r.check_id, r.load_date]
        assert (r.passed, r.weekday_used) == (b.passed, b.weekday_used)
        assert (r.center, r.lo, r.hi, r.score) == pytest.approx((b.center, b.lo, b.hi, b.score), nan_ok=True) if b.center is not None \
            else r.center is None


def test_publications_one_after_the_other_equal_one_replay(series):
    df, _ = series
    whole = {(r.check_id, r.load_date): r.passed for r in replay(df).collect()}
    cut = MONDAY + timedelta(days=90)
    first = replay(df.where(F.col("load_date") < F.lit(cut))).cache()
    seeds = base_points(metrics_of(first)).where("check_id <> 'rows'").unionByName(
        first.where("volume and passed").select("table", "check_id", "load_date", "value"))
    second = replay(df.where(F.col("load_date") >= F.lit(cut)), seeds)
    got = {(r.check_id, r.load_date): r.passed for r in first.unionByName(second).collect()}
    assert got == whole


def test_a_republished_day_forgets_its_own_point(spark):
    rows = [("t", "a", MONDAY + timedelta(days=i), 100.0 + i % 3, 3.0, False, False) for i in range(10)]
    seeds = spark.createDataFrame([(t, c, d, v) for t, c, d, v, *_ in rows], "table string, check_id string, load_date date, value double")
    again = spark.createDataFrame([("t", "a", MONDAY + timedelta(days=9), 100.0, 3.0, False, False)], SCHEMA)
    (r,) = replay(again, seeds).collect()
    assert r.center == statistics.median([100.0 + i % 3 for i in range(9)])


def test_center_by_weekday_and_by_trailing_days():
    points = [(i, 500.0 if i % 7 == 0 else 100.0) for i in range(56)]
    assert CleanHistory(3, True, False, points).judge(56, 500.0)[1] == 500
    assert CleanHistory(3, False, False, points).judge(56, 500.0)[1] == 100
    assert CleanHistory(3, False, False, points[:3]).judge(56, 1.0) == (False, None, None, None, None, None, True)


def test_only_sixty_clean_points_count_before_weekdays_are_matched():
    points = [(i, 1000.0) for i in range(0, 70, 7)] + [(70 + i, 10.0) for i in range(60)]
    # of the same weekday only the points among the last 60 remain
    assert CleanHistory(3, True, False, points).judge(133, 10.0)[1] == 10


def verdict(history, rows, day=MONDAY, same_weekday=True):
    points = [((d - date(1970, 1, 1)).days, float(v)) for d, v in history]
    return CleanHistory(3.5, same_weekday, True, points).judge((day - date(1970, 1, 1)).days, float(rows))


def test_volume_learns_weekdays_and_flags_drops_and_spikes():
    history = sorted((MONDAY - timedelta(days=7 * w) + timedelta(days=o), n + w) for w in range(1, 7) for o, n in ((0, 700), (6, 200)))
    assert verdict(history, 690)[-1]
    assert not any(verdict(history, n)[-1] for n in (0, 250, 1400))
    assert verdict(history, 700)[0]


def test_volume_of_sparse_tables_looks_at_all_days():
    counts = [1, 0, 2, 4, 2, 3, 7, 4, 4, 6, 3, 9, 10, 3, 10, 7, 5, 8, 0, 6, 9]
    history = [(MONDAY - timedelta(days=21 - i), n) for i, n in enumerate(counts)]
    assert verdict(history, 13)[-1] and verdict(history, 0)[-1] and not verdict(history, 120)[-1]
    zeros = [(MONDAY - timedelta(days=10 - i), 0) for i in range(10)]
    assert verdict(zeros, 1)[-1] and not verdict(zeros, 50)[-1]


def test_volume_messages(spark):
    history = [("t", "rows", MONDAY - timedelta(days=7 * w), 700.0 + w, 3.5, True, True) for w in range(8, 0, -1)]
    for rows, text in ((0, "change: -100%"), (250, "change: -64%"), (1400, "change: +99%"), (700, "compared with: Monday")):
        df = spark.createDataFrame(history + [("t", "rows", MONDAY, float(rows), 3.5, True, True)], SCHEMA)
        last = volume_results(replay(df)).where(F.col("load_date") == F.lit(MONDAY)).first()
        assert text in last.message, last.message


def test_history_and_expected_rows(spark):
    days = [MONDAY - timedelta(days=i) for i in range(80, 0, -1)]
    metrics = spark.createDataFrame([(d, "t", "rows:base", float(i)) for i, d in enumerate(days)], "load_date date, table string, metric string, value double")
    kept = clean_history(metrics, F.lit(MONDAY - timedelta(days=1)))
    assert kept.count() == 60 and kept.agg(F.max("load_date")).first()[0] == MONDAY - timedelta(days=2)
    asked = spark.createDataFrame([("t", MONDAY, "snapshot")], "table string, load_date date, load_type string")
    assert expected_rows(base_points(metrics), asked).first().expected_rows == 72  # median of 66..79 is 72.5: half to even
