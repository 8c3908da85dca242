"""Clean baselines and incidents that carry their state from one publication to the next."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadwatch.model import HISTORY_POINTS
from loadwatch.operators.baseline import KEY, CleanHistory

_POINTS = "day int, value double"
_BANDS = ("table string, check_id string, day int, value double, z double, volume boolean, weekday_used boolean, "
          "center double, spread double, lo double, hi double, score double, passed boolean")
_EVENTS = ("table string, number bigint, load_date string, minute int, position int, kind string, severity string, "
           "title string, loads_failed bigint")


class BaselineState(StatefulProcessor):
    """Judges the points of a series in day order; a day published again replaces its own point.

    The state holds a clean point of 12 bytes per day. With `days_kept`, points older than so many days before the newest one
    go, but never the last ones a day at that limit is compared with.
    """

    def __init__(self, days_kept: int | None = None) -> None:
        self._days_kept = days_kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._points = handle.getListState("points", _POINTS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._points.put(sorted((int(d), float(v)) for d, v in zip(initialState["day"], initialState["value"], strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["day", "revision"], kind="stable")
        clean = [(int(d), float(v)) for d, v in self._points.get()]
        out = []
        for r in new.itertuples(index=False):
            day, value = int(r.day), float(r.value)
            clean = [p for p in clean if p[0] != day]
            history = CleanHistory(float(r.z), bool(r.same_weekday), bool(r.volume), (p for p in clean if p[0] < day))
            used, center, spread, lo, hi, score, passed = history.judge(day, value)
            if passed:
                insort(clean, (day, value))
            out.append((key[0], key[1], day, value, float(r.z), bool(r.volume), bool(used), center, spread, lo, hi,
                        score, bool(passed), int(r.revision)))
        if self._days_kept is not None and clean:
            limit = bisect_left(clean, (clean[-1][0] - self._days_kept,))
            clean = clean[max(0, limit - HISTORY_POINTS):]
        self._points.put(clean)
        frame = pd.DataFrame(out, columns=[*(c.split(" ")[0] for c in _BANDS.split(", ")), "revision"])
        for name in ("center", "spread", "lo", "hi", "score"):
            frame[name] = frame[name].astype("float64")
        yield frame

    def close(self) -> None:
        pass


def stateful_bands(series: DataFrame, days_kept: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Bands of a stream of daily points, as `loadwatch.operators.baseline.replay` gives in batch. `days_kept`: how far back a
    day may still be published again; by default any day (the store's own horizon is `DAYS_HISTORY`). `known`: clean points (table, check_id, load_date, value) that the store
    holds of earlier days; the stream goes on from there. A column `revision` orders several values of one day in one batch."""
    revision = F.col("revision") if "revision" in series.columns else F.lit(0)
    day = F.unix_date("load_date").alias("day")
    judged = series.select(*KEY, day, "value", "z", "same_weekday", "volume", revision.cast("bigint").alias("revision")) \
        .groupBy(*KEY).transformWithStateInPandas(
            statefulProcessor=BaselineState(days_kept), outputStructType=_BANDS + ", revision bigint", outputMode="Append", timeMode="None",
            initialState=None if known is None else known.select(*KEY, day, "value").groupBy(*KEY))
    if "revision" not in series.columns:
        judged = judged.drop("revision")
    more = ["revision"] if "revision" in series.columns else []
    return judged.select(*KEY, F.date_from_unix_date("day").alias("load_date"), "value", "z", "volume", "weekday_used",
                         *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("center", "spread", "lo", "hi", "score")], "passed", *more)


class IncidentState(StatefulProcessor):
    """Opens, keeps and resolves the incident of a table as its observations arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("incident", "number bigint, open string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, current = 0, None
        if self._state.exists():
            number, text = self._state.get()
            current = json.loads(text) if text else None
        events = []
        ordered = pd.concat(list(rows)).sort_values(["seq", "load_date", "minute"], kind="stable")

        def emit(r, position, kind, day=None, minute=None):
            events.append((key[0], int(number), day or r.load_date, int(r.minute if minute is None else minute), position,
                           kind, current["severity"], current["title"], int(current["loads_failed"])))

        for r in ordered.itertuples(index=False):
            failing = int(r.weight) > 0
            if failing and current is None:
                number += 1
                current = {"severity": r.severity, "weight": int(r.weight), "title": r.title, "day": r.load_date,
                           "opened": [r.load_date, int(r.minute)], "loads_failed": 1}
                emit(r, 0, "detected")
                continue
            if current is None:
                continue
            if not failing:
                day, minute = max([r.load_date, int(r.minute)], current["opened"])
                emit(r, 5, "resolved", day, minute)
                current = None
                continue
            again = r.load_date != current["day"]
            current["day"], current["loads_failed"] = r.load_date, current["loads_failed"] + int(again)
            if again:
                emit(r, 2, "persists")
            if int(r.weight) > current["weight"]:
                current.update(weight=int(r.weight), severity=r.severity)
                emit(r, 3, "escalated")
        self._state.update((number, json.dumps(current) if current else ""))
        yield pd.DataFrame(events, columns=[c.split(" ")[0] for c in _EVENTS.split(", ")])

    def close(self) -> None:
        pass


def stateful_incidents(obs: DataFrame) -> DataFrame:
    """Incident events of a stream of observations; `number` counts the incidents of each table."""
    main = F.get("checks", 0)
    flat = obs.select("table", "seq", F.col("load_date").cast("string").alias("load_date"), "minute",
                      F.coalesce(main["weight"], F.lit(0)).alias("weight"), F.coalesce(main["severity"], F.lit("")).alias("severity"),
                      F.coalesce(main["name"], F.lit("")).alias("title"))
    events = flat.groupBy("table").transformWithStateInPandas(
        statefulProcessor=IncidentState(), outputStructType=_EVENTS, outputMode="Append", timeMode="None")
    return events.withColumn("load_date", F.to_date("load_date"))
