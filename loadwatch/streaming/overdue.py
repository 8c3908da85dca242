"""Overdue sources as events: a timer for the next deadline of each source, put off by its publications."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadwatch.model import GRACE_MINUTES, Catalog
from loadwatch.operators.monitors import overdue_checks

DAY = 86_400_000
_LATE = "source string, day int, table string, expected_at int, published bigint"


class Deadlines(StatefulProcessor):
    """Of one source: when it published last, and up to when deadlines have been judged. Times are milliseconds of people's own clock."""

    def __init__(self, due: list[tuple[str, int]]) -> None:
        self._due = due  # (table, expected minute)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("source", "published bigint, judged bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for frame in rows for t in frame["at_ms"])
        published, judged = self._state.get() if self._state.exists() else (times[0], times[0])
        late = []
        for t in times:
            late += self._missed(key[0], published, judged, t)
            published, judged = max(published, t), max(judged, t)
        yield self._keep(late, published, judged)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        published, judged = self._state.get()
        now = max(judged, timerValues.getCurrentWatermarkInMs())
        yield self._keep(self._missed(key[0], published, judged, now), published, now)

    def _deadline(self, day: int, minute: int) -> int:
        return day * DAY + (minute + GRACE_MINUTES) * 60_000

    def _missed(self, source: str, published: int, since: int, until: int) -> list[tuple]:
        """Deadlines after `since` and up to `until` on days later than the last publication's."""
        days = range(max(published // DAY + 1, since // DAY - 1), until // DAY + 1)
        return [(source, day, table, minute, published) for day in days for table, minute in self._due if since < self._deadline(day, minute) <= until]

    def _keep(self, late: list[tuple], published: int, judged: int) -> pd.DataFrame:
        self._state.update((published, judged))
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        ahead = [self._deadline(day, m) for day in (judged // DAY, judged // DAY + 1) if day > published // DAY for _, m in self._due]
        ahead = [t for t in ahead if t > judged] or [self._deadline(published // DAY + 1, m) for _, m in self._due]
        self._handle.registerTimer(min(ahead))
        return pd.DataFrame(late, columns=[c.split(" ")[0] for c in _LATE.split(", ")])

    def close(self) -> None:
        pass


def overdue_stream(publications: DataFrame, clock: DataFrame, catalog: Catalog, source: str = "source", title: str = "The source") -> DataFrame:
    """Availability failures of a source's tables, each table once a day, as its deadline passes without a publication that day.

    `publications` has `published`, `clock` has `now` (timestamps of the session's zone): a stream that only moves time, such as the rate source. A
    deadline is judged when the clock has passed it, after the publications that came until then.
    """
    def local(column: str):
        return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())

    told = publications.select(F.lit(source).alias("source"), local("published").alias("at"), F.lit(True).alias("told"))
    moved = clock.select(F.lit(source).alias("source"), local("now").alias("at"), F.lit(False).alias("told"))
    both = told.unionByName(moved).withWatermark("at", "0 seconds")
    due = [(t.name, t.expected_at) for t in catalog.tables]
    # Rows of the clock move the watermark and go no further. The condition names `at`, or it would be pushed below the watermark.
    late = both.where(F.when(F.col("told"), F.col("at")).isNotNull()).select("source", "at", F.unix_millis("at").alias("at_ms")).groupBy("source").transformWithStateInPandas(
        statefulProcessor=Deadlines(due), outputStructType=_LATE, outputMode="Append", timeMode="EventTime")
    shown = late.select(F.date_from_unix_date("day").alias("load_date"), "table", "expected_at", F.timestamp_millis("published").alias("published"))
    back = F.to_utc_timestamp("published", F.current_timezone())
    return overdue_checks(shown.withColumn("published", back), title)
