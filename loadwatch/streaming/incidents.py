"""Incidents as a stream: observations and analyst actions in one order, state by table, continued from what the store knows.

Both inputs are one stream of events of a table, ordered as in batch by (seq, load_date, minute, turn). Event time counts publications (`seq` as
seconds): with a delay of n, the events of a publication wait until n later ones have begun, so that actions may come that much after the
observations they answer, and in any order of files. Every event that changes an incident gives its whole row anew; the newest row of
(table, number) is the incident. An event later than the watermark is applied when it comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadwatch.operators import incidents as inc

CHECKS = inc.OBSERVATION_SCHEMA[inc.OBSERVATION_SCHEMA.index("checks array") + len("checks "):]
_ROWS = ("table string, number bigint, change bigint, kind string, severity string, title string, status string, opened_date string, opened_minute int, "
         "resolved_date string, resolved_minute int, resolution string, loads_failed bigint, run_id string, checks string")
_NAMES = [c.split(" ")[0] for c in _ROWS.split(", ")]


def events(obs: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Observations and actions as one stream: `at` is event time, `what` the event, `checks` JSON."""
    none = F.lit(None).cast("string")
    shared = [F.timestamp_seconds("seq").alias("at"), "table", "seq", F.col("load_date").cast("string").alias("load_date"), "minute"]
    seen = obs.select(*shared, F.lit(0).alias("turn"), F.when(F.size("checks") > 0, "fail").otherwise("pass").alias("what"), "run_id", F.to_json("checks").alias("checks"))
    if actions is None:
        return seen
    return seen.unionByName(actions.select(*shared, F.lit(1).alias("turn"), F.col("action").alias("what"), none.alias("run_id"), none.alias("checks")))


def known_incidents(obs: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """What the store knows, as a start for the stream: (table, number of incidents so far, changes so far, the unresolved one as JSON)."""
    facts = inc._facts(inc._stream(obs, actions))
    fail = F.col("event") == "fail"
    newest = Window.partitionBy("table").orderBy(F.desc("island"))
    last_day = facts.groupBy("table", "island").agg(F.max_by("load_date", F.when(fail, F.col("at"))).alias("last_day"), F.max("main.weight").alias("weight"))
    found = inc._collapse(facts).withColumn("age", F.row_number().over(newest)).where("age = 1").join(last_day, ["table", "island"])
    current = F.struct("severity", "weight", "title", F.array(F.col("opened_date").cast("string"), F.col("opened_minute").cast("string")).alias("opened"),
                       F.col("last_day").cast("string").alias("day"), "loads_failed", F.coalesce("run_id", F.lit("")).alias("run_id"), F.to_json("checks").alias("checks"),
                       (F.col("status") == "escalated").alias("escalated"))
    return found.select("table", F.col("island").cast("bigint").alias("number"),
                        F.when(F.col("resolved_date").isNull(), F.to_json(current)).otherwise("").alias("open"))


class IncidentLog(StatefulProcessor):
    """The incident of a table, and the events that wait for earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("incident", "number bigint, changes bigint, open string")
        self._waiting = handle.getListState("waiting", "event string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self._state.update((int(first["number"]), 0, first["open"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r._asdict() for frame in rows for r in frame.itertuples(index=False)]
        waiting = [json.loads(e[0]) for e in self._waiting.get()] if self._waiting.exists() else []
        for r in new:
            text = {k: None if pd.isna(r[k]) else r[k] for k in ("load_date", "what", "run_id", "checks")}
            waiting.append({"order": [int(r["seq"]), r["load_date"], int(r["minute"]), int(r["turn"])], **text})
        for seconds in {e["order"][0] for e in waiting}:
            self._handle.registerTimer(max(seconds * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._release(key, waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, [json.loads(e[0]) for e in self._waiting.get()] if self._waiting.exists() else [], timerValues)

    def _release(self, key, waiting: list[dict], timerValues) -> pd.DataFrame:
        """Apply, in order, what the watermark has passed; the rest stays."""
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((e for e in waiting if e["order"][0] * 1000 <= passed), key=lambda e: e["order"])
        rest = [e for e in waiting if e["order"][0] * 1000 > passed]
        if rest:
            self._waiting.put([(json.dumps(e),) for e in rest])
        else:
            self._waiting.clear()
        number, changes, text = self._state.get() if self._state.exists() else (0, 0, "")
        current, out = json.loads(text) if text else None, []
        for e in due:
            kind, number, current = self._step(e, number, current)
            if kind:
                changes += 1
                out.append(_row(key[0], number, changes, kind, current))
            if current and "resolved" in current:
                current = None
        if due:
            self._state.update((number, changes, json.dumps(current) if current else ""))
        frame = pd.DataFrame(out, columns=_NAMES)
        for name in ("opened_minute", "resolved_minute"):
            frame[name] = frame[name].astype("Int32")
        return frame

    @staticmethod
    def _step(e: dict, number: int, current: dict | None):
        _, day, minute, _ = e["order"]
        if e["what"] == "fail":
            checks = json.loads(e["checks"])
            main, run = checks[0], e["run_id"] or ""
            fresh = {"day": day, "checks": e["checks"]}
            if current is None:
                return "detected", number + 1, {**fresh, "severity": main["severity"], "weight": main["weight"], "title": main["name"], "opened": [day, str(minute)],
                                                "loads_failed": 1, "run_id": run, "escalated": False}
            kind = "persists" if day != current["day"] else "evidence"
            if kind == "persists":
                fresh |= {"loads_failed": current["loads_failed"] + 1, "run_id": run or current["run_id"]}
            if main["weight"] > current["weight"]:
                fresh |= {"weight": main["weight"], "severity": main["severity"]}
            return kind, number, {**current, **fresh}
        if current is None:
            return None, number, None
        if e["what"] == "escalate":
            return "escalated", number, {**current, "escalated": True}
        end = max([day, minute], [current["opened"][0], int(current["opened"][1])])
        return "resolved", number, {**current, "resolved": end, "resolution": "manual" if e["what"] == "resolve" else "automatic"}

    def close(self) -> None:
        pass


def _row(table: str, number: int, change: int, kind: str, c: dict) -> tuple:
    ended = c.get("resolved", [None, None])
    status = "resolved" if ended[0] else "escalated" if c["escalated"] else "open"
    return (table, number, change, kind, c["severity"], c["title"], status, c["opened"][0], int(c["opened"][1]), ended[0], ended[1], c.get("resolution"),
            c["loads_failed"], c["run_id"] or None, c["checks"])


def stateful_log(stream: DataFrame, delay: int = 0, known: DataFrame | None = None) -> DataFrame:
    """Rows of incidents, one at every change, of a stream of `events`. `known`: what `known_incidents` gives for the events before it."""
    late = stream.withWatermark("at", f"{delay} seconds")
    told = late.groupBy("table").transformWithStateInPandas(
        statefulProcessor=IncidentLog(), outputStructType=_ROWS, outputMode="Append", timeMode="EventTime",
        initialState=None if known is None else known.groupBy("table"))
    dated: dict[str, Column] = {c: F.to_date(c) for c in ("opened_date", "resolved_date")}
    return told.withColumns({**dated, "checks": F.from_json("checks", CHECKS)})


def newest(log: DataFrame) -> DataFrame:
    """The incidents as they stand: the last row of each."""
    order = Window.partitionBy("table", "number").orderBy(F.desc("change"))
    return log.withColumn("__age", F.row_number().over(order)).where("__age = 1").drop("__age", "change", "kind")
