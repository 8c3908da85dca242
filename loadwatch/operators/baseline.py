"""What is normal for a daily series: a robust band that only learns from days that passed.

Three executions of the same definition:

* `replay` walks whole series in day order (a day joins the history only if it passed, so the history of a
  day depends on every verdict before it: no window frame can express that);
* `score_new_loads` scores new days against a stored clean history with array expressions, without Python;
* `loadwatch.streaming.state` keeps the history between publications.

A series is one row per (table, check, day): its length is bounded by the calendar, not by the data.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwatch.functions.scalars import array_median, array_stddev, band, fact_line, half_even, locale_number, thousands
from loadwatch.model import (FAIL, HISTORY_POINTS, MIN_POINTS, OK, SPARSE_ROWS, TRAILING_POINTS, VOLUME_Z,
                             WEEKDAY_POINTS)

KEY = ["table", "check_id"]
BAND_SCHEMA = ("table string, check_id string, load_date date, value double, z double, volume boolean, "
               "weekday_used boolean, center double, spread double, lo double, hi double, score double, passed boolean")
BAND_COLUMNS = [c.split(" ")[0] for c in BAND_SCHEMA.split(", ")]

# How the spread of a band is floored.
MAD_SCALE = 1.4826
RELATIVE_FLOOR = 0.05
ABSOLUTE_FLOOR = 1e-9

# A point as close as this to the edge of its band, in spreads, is on it and passes: one rule for the replay, the one-day path and
# streams, so that the rounding of a sum never decides.
TIE = 1e-9


# ------------------------------------------------------------- one series
def _median(ordered: list[float]) -> float:
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def _deviation(values: list[float]) -> float:
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))


class CleanHistory:
    """The last clean points of one series and the band they give for the next day."""

    __slots__ = ("points", "z", "same_weekday", "volume")

    def __init__(self, z: float, same_weekday: bool, volume: bool, points=()):
        self.points: deque[tuple[int, float]] = deque(points, maxlen=HISTORY_POINTS)  # (day number, value)
        self.z, self.same_weekday, self.volume = z, same_weekday, volume

    def learn(self, day: int, value: float) -> None:
        self.points.append((day, value))

    def _sample(self, day: int) -> tuple[list[float], float, bool, bool]:
        """Comparable values, smallest spread to allow, whether weekdays were matched, whether rows are few."""
        matched, least, sparse = self.same_weekday, 0.0, False
        if self.volume:
            typical = _median(sorted(v for _, v in self.points)) if self.points else 0.0
            sparse = typical < SPARSE_ROWS
            matched = matched and not sparse
            least = max(1.0, math.sqrt(typical))
        if matched:
            values = [v for d, v in self.points if (d - day) % 7 == 0][-WEEKDAY_POINTS:]
        else:
            values = [v for _, v in self.points][-TRAILING_POINTS:]
        return values, least, matched, sparse

    def judge(self, day: int, value: float):
        """(weekday_used, center, spread, lo, hi, score, passed); Nones while the history is too short."""
        sample = self._sample(day)
        if len(sample[0]) < MIN_POINTS:
            return sample[2], None, None, None, None, None, True
        values, least, matched, sparse = sample
        center = _median(sorted(values))
        mad = _median(sorted(abs(v - center) for v in values))
        spread = max(_deviation(values), MAD_SCALE * mad, abs(center) * RELATIVE_FLOOR, least, ABSOLUTE_FLOOR)
        lo, hi = center - self.z * spread, center + self.z * spread
        score = (value - center) / spread
        if not self.volume:
            return matched, center, spread, lo, hi, score, abs(score) <= self.z + TIE
        lo = max(lo, 0.0)
        if sparse:
            lo, hi = 0.0, max(hi, 3 * center, float(SPARSE_ROWS))
        return matched, center, spread, lo, hi, score, lo - TIE * spread <= value <= hi + TIE * spread


def _replay_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("day", kind="stable")
    first = pdf.iloc[0]
    history = CleanHistory(float(first["z"]), bool(first["same_weekday"]), bool(first["volume"]))
    verdicts, kept = [], []
    for i, (day, value, seed) in enumerate(zip(pdf["day"].tolist(), pdf["value"].tolist(), pdf["seed"].tolist())):
        if seed:
            history.learn(day, value)
            continue
        verdict = history.judge(day, value)
        if verdict[-1]:
            history.learn(day, value)
        verdicts.append(verdict)
        kept.append(i)
    out = pdf.iloc[kept][["table", "check_id", "day", "value", "z", "volume"]].reset_index(drop=True)
    names = ["weekday_used", "center", "spread", "lo", "hi", "score", "passed"]
    judged = pd.DataFrame(verdicts, columns=names)
    for name in names[1:-1]:
        out[name] = judged[name].astype("float64") if len(judged) else np.array([], dtype="float64")
    out["weekday_used"] = judged["weekday_used"].astype(bool)
    out["passed"] = judged["passed"].astype(bool)
    return out


_GROUP_SCHEMA = BAND_SCHEMA.replace("load_date date", "day int").replace(
    "weekday_used boolean, center double, spread double, lo double, hi double, score double, passed boolean",
    "center double, spread double, lo double, hi double, score double, weekday_used boolean, passed boolean")


def replay(series: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Bands and verdicts for every point of `series` (table, check_id, load_date, value, z, same_weekday, volume).

    `seeds` are clean points already known (table, check_id, load_date, value): they teach and are not judged.
    """
    day = F.unix_date("load_date").alias("day")
    points = series.select(*KEY, day, "value", "z", "same_weekday", "volume", F.lit(False).alias("seed"))
    if seeds is not None:
        policy = series.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("z", "same_weekday", "volume")])
        known = seeds.join(series.select(*KEY, "load_date"), [*KEY, "load_date"], "left_anti").join(policy, KEY)
        points = points.unionByName(
            known.select(*KEY, day, "value", "z", "same_weekday", "volume", F.lit(True).alias("seed")))
    judged = points.groupBy(*KEY).applyInPandas(_replay_group, _GROUP_SCHEMA)
    numbers = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("center", "spread", "lo", "hi", "score")]
    return judged.select(*KEY, F.date_from_unix_date("day").alias("load_date"), "value", "z", "volume",
                         "weekday_used", *numbers, "passed")


# -------------------------------------------------- stored history, no Python
def clean_history(metrics: DataFrame, before: Column, limit: int = HISTORY_POINTS) -> DataFrame:
    """The last `limit` clean points strictly before a day, from the stored `<metric>:base` series."""
    latest = Window.partitionBy("table", "metric").orderBy(F.desc("load_date"))
    return (metrics.where(F.col("metric").endswith(":base") & (F.col("load_date") < before))
            .withColumn("age", F.row_number().over(latest)).where(F.col("age") <= limit)
            .select("table", "metric", "load_date", "value", "age"))


def base_points(metrics: DataFrame) -> DataFrame:
    """Stored clean points as (table, check_id, load_date, value)."""
    name = F.regexp_replace(F.regexp_replace("metric", ":base$", ""), "^rule:", "")
    return metrics.where(F.col("metric").endswith(":base")).select(
        "table", name.alias("check_id"), "load_date", "value")


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), F.lit(n))


def score_new_loads(history: DataFrame, today: DataFrame) -> DataFrame:
    """Bands and verdicts of new days against clean points (table, check_id, load_date, value), not learning between them."""
    own = ["value", "z", "same_weekday", "volume"]
    asked = today.select(*KEY, "load_date", *own, F.lit(0).alias("known"), F.lit(None).cast("double").alias("point"))
    points = history.join(today.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, "load_date", *[F.lit(None).cast(today.schema[c].dataType).alias(c) for c in own], F.lit(1).alias("known"),
        F.col("value").alias("point"))
    # One ordered walk over points and asked days: a day sees the points numbered up to it, of earlier days only.
    series = Window.partitionBy(*KEY)
    numbered = asked.unionByName(points).withColumn("number", F.sum("known").over(
        series.orderBy("load_date", "known").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = series.orderBy("number").rangeBetween(1 - HISTORY_POINTS, Window.currentRow)
    pair = F.when(F.col("known") == 1, F.struct(F.col("load_date").alias("point_date"), "point"))
    s = numbered.withColumn("points", F.sort_array(F.collect_list(pair).over(last))).where("known = 0")
    s = s.withColumn("typical", F.when(F.col("volume"), F.coalesce(array_median(F.col("points.point")), F.lit(0.0))))
    sparse = F.col("volume") & (F.col("typical") < SPARSE_ROWS)
    s = s.withColumn("sparse", F.coalesce(sparse, F.lit(False)))
    s = s.withColumn("weekday_used", F.col("same_weekday") & ~F.col("sparse"))
    matching = F.filter("points", lambda p: F.weekday(p["point_date"]) == F.weekday(F.col("load_date")))
    s = s.withColumn("sample", F.transform(
        F.when(F.col("weekday_used"), _last(matching, WEEKDAY_POINTS)).otherwise(_last(F.col("points"), TRAILING_POINTS)),
        lambda p: p["point"]))
    s = s.withColumn("center", F.when(F.size("sample") >= MIN_POINTS, array_median(F.col("sample"))))
    mad = array_median(F.transform("sample", lambda v: F.abs(v - F.col("center"))))
    least = F.when(F.col("volume"), F.greatest(F.lit(1.0), F.sqrt("typical"))).otherwise(F.lit(0.0))
    spread = F.greatest(array_stddev(F.col("sample")), MAD_SCALE * mad, F.abs("center") * RELATIVE_FLOOR, least,
                        F.lit(ABSOLUTE_FLOOR))
    s = s.withColumn("spread", F.when(F.col("center").isNotNull(), spread))
    low, high = F.col("center") - F.col("z") * F.col("spread"), F.col("center") + F.col("z") * F.col("spread")
    known = F.col("center").isNotNull()
    s = s.withColumn("lo", F.when(known, F.when(F.col("sparse"), F.lit(0.0)).when(F.col("volume"), F.greatest(low, F.lit(0.0)))
                                  .otherwise(low)))
    s = s.withColumn("hi", F.when(known, F.when(F.col("sparse"), F.greatest(high, 3 * F.col("center"), F.lit(float(SPARSE_ROWS))))
                                  .otherwise(high)))
    s = s.withColumn("score", (F.col("value") - F.col("center")) / F.col("spread"))
    slack = TIE * F.col("spread")
    inside = F.when(F.col("volume"), F.col("value").between(F.col("lo") - slack, F.col("hi") + slack)) \
        .otherwise(F.abs("score") <= F.col("z") + TIE)
    return s.withColumn("passed", F.coalesce(inside, F.lit(True))).select(*BAND_COLUMNS)


# ------------------------------------------------------------------- series
def outlier_series(stats: DataFrame, facts: DataFrame) -> DataFrame:
    """The series outlier rules watch, from the daily statistics."""
    return stats.where(F.col("kind") == "outlier").select(*KEY, "load_date", "value") \
        .join(facts.select(*KEY, "z", "same_weekday"), KEY) \
        .select(*KEY, "load_date", "value", "z", "same_weekday", F.lit(False).alias("volume"))


def volume_series(stats: DataFrame, specs: DataFrame) -> DataFrame:
    """Row counts as series judged by the volume policy; weekdays matter for incremental tables only."""
    return stats.where(F.col("kind") == "rows").select("table", "load_date", "value") \
        .join(specs.select("table", "load_type"), "table") \
        .select("table", F.lit("rows").alias("check_id"), "load_date", "value", F.lit(VOLUME_Z).alias("z"),
                (F.col("load_type") == "incremental").alias("same_weekday"), F.lit(True).alias("volume"))


# ------------------------------------------------------------------ results
NO_BAND = "no band yet"


def metrics_of(bands: DataFrame) -> DataFrame:
    """Long metrics of the bands: value, band, expected rows and, on clean days, the base point."""
    name = F.when(F.col("volume"), F.lit("rows")).otherwise(F.concat(F.lit("rule:"), "check_id"))

    def point(suffix: str, value: Column) -> Column:
        return F.struct(F.concat(name, F.lit(suffix)).alias("metric"), value.alias("value"))

    rows = F.array(point("", F.col("value")), point(":lo", F.col("lo")), point(":hi", F.col("hi")),
                   point(":expected", F.when(F.col("volume"), F.col("center"))),
                   point(":base", F.when(F.col("passed"), F.col("value"))))
    return bands.select("load_date", "table", F.inline(rows)).where("value is not null") \
        .select("load_date", "table", "metric", "value")


def outlier_results(bands: DataFrame, facts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Check results of the outlier rules; `totals` (table, load_date, row_count) adds the rows of each load."""
    lo, hi = locale_number(F.col("lo")), locale_number(F.col("hi"))
    shift = F.format_string("%+.1f", half_even(F.col("score"), 1))
    said = fact_line(value=locale_number(F.col("value")), band=F.when(F.col("center").isNotNull(), band(lo, hi)), usual=F.when(F.col("center").isNotNull(), locale_number(F.col("center"))),
                 spreads_away=F.when(~F.col("passed"), shift), of=F.concat("aggregate", F.lit(" "), "column"))
    limit = F.when(F.col("center").isNull(), NO_BAND).otherwise(band(lo, hi))
    judged = bands.where(~F.col("volume")).drop("z").join(facts, KEY)
    total = F.lit(None).cast("bigint")
    if totals is not None:
        judged = judged.join(totals, ["table", "load_date"], "left")
        total = F.col("row_count").cast("bigint")
    return judged.select(
        "load_date", "table", "check_id", "check_order", "name", F.lit("rule").alias("kind"), "severity",
        F.lit("outlier").alias("rule_type"), F.when(F.col("passed"), OK).otherwise(FAIL).alias("status"),
        half_even(F.col("value"), 4).alias("value"), limit.alias("threshold"), said.alias("message"),
        F.lit(0).cast("bigint").alias("failing_rows"), total.alias("total_rows"), "sql")


def volume_results(bands: DataFrame) -> DataFrame:
    """Check results of the volume monitor; the `rule_type` of a failure says the direction, `volume_low` or `volume_high`."""
    rows, center, lo, hi = F.col("value"), F.col("center"), thousands(F.col("lo")), thousands(F.col("hi"))
    days = F.when(F.col("weekday_used"), F.date_format("load_date", "EEEE")).otherwise(F.lit("any day"))
    change = F.format_string("%+.0f%%", half_even(100 * (rows - center) / center, 0))
    known = center.isNotNull()
    said = fact_line(rows=thousands(rows), band=F.when(known, band(lo, hi)), usual=F.when(known, thousands(center)),
                 change=F.when(~F.col("passed") & (center >= 1), change), compared_with=F.when(known, days))
    limit = F.when(known, band(lo, hi)).otherwise(NO_BAND)
    kind = F.when(F.col("passed"), F.lit("volume")).when(rows < center, F.lit("volume_low")).otherwise(F.lit("volume_high"))
    return bands.where(F.col("volume")).select(
        "load_date", "table", F.lit("volume").alias("check_id"), F.lit(1).alias("check_order"),
        F.lit("Row volume").alias("name"), F.lit("monitor").alias("kind"), F.lit("high").alias("severity"),
        kind.alias("rule_type"), F.when(F.col("passed"), OK).otherwise(FAIL).alias("status"),
        rows.alias("value"), limit.alias("threshold"), said.alias("message"),
        F.lit(0).cast("bigint").alias("failing_rows"), rows.cast("bigint").alias("total_rows"),
        F.lit(None).cast("string").alias("sql"))


def expected_rows(history: DataFrame, days: DataFrame) -> DataFrame:
    """Rows expected on a day for display: center of the clean counts, without the volume policy's own floors."""
    plain = days.select("table", F.lit("rows").alias("check_id"), "load_date", F.lit(0.0).alias("value"),
                        F.lit(VOLUME_Z).alias("z"), (F.col("load_type") == "incremental").alias("same_weekday"),
                        F.lit(False).alias("volume"))
    return score_new_loads(history, plain).select(
        "table", "load_date", half_even(F.col("center"), 0).cast("bigint").alias("expected_rows"))
