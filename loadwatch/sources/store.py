"""The monitor's own tables: rows as loaded, delivery log, metrics, check results and observations.

Rows are Parquet folders by load date and, below it, by the write they came with: a write adds its own folder, and then
those of the writes it replaces go. The result tables are small (a few rows per table and day) and are kept by month, so that
years of history stay a handful of files, and reads name the months they need. Validating a day again replaces what it had: a
retried or repeated write leaves the same result.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwatch.model import CHECK_SCHEMA, LOAD_SCHEMA, METRIC_SCHEMA, TableSpec
from loadwatch.operators.incidents import ACTION_SCHEMA, CLOSED_SCHEMA, OBSERVATION_SCHEMA
from loadwatch.operators.sketches import PROFILE_SCHEMA
from loadwatch.session import stage
from loadwatch.sources.connector import path_exists

PUBLICATION_SCHEMA = ("seq bigint, run_id string, published_at string, published timestamp, fingerprint string, "
                      "load_date date, datasets map<string,bigint>")
EXAMPLE_SCHEMA = "load_date date, table string, check_id string, position int, shown string"
SCHEMAS = {
    "examples": EXAMPLE_SCHEMA,
    "closed_incidents": CLOSED_SCHEMA,
    "loads": LOAD_SCHEMA,
    "metrics": METRIC_SCHEMA,
    "check_results": CHECK_SCHEMA,
    "observations": OBSERVATION_SCHEMA,
    "publications": PUBLICATION_SCHEMA,
    "actions": ACTION_SCHEMA,
    "profiles": PROFILE_SCHEMA,
}
BY_MONTH = ("loads", "metrics", "check_results", "examples", "profiles")  # the others are appended, one partition per publication
DAYS_ROWS, DAYS_HISTORY = 7, 120  # what retention keeps unless told otherwise


def stored_schema(spec: TableSpec) -> T.StructType:
    """Types of the rows of a table as stored: booleans are 0 and 1."""
    kinds = [(c.name, "int" if c.data_type() == "boolean" else c.data_type()) for c in spec.columns if c.name != "load_date"]
    return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in kinds))


class Store:
    """Result tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, df: DataFrame, name: str, partitions: list[str], one_folder: bool = False) -> None:
        # rebalance: one writer per partition folder, and adaptive execution splits a folder that is too large for one;
        # rows that all go to one folder are written by the tasks that have them
        spread = df if one_folder else df.hint("rebalance", *[F.col(c) for c in partitions])
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(*partitions).parquet(self._path(name))

    # ------------------------------------------------------------- results
    def read(self, name: str, first: date | None = None, last: date | None = None, months: list[str] | None = None) -> DataFrame:
        """A result table; empty with its schema before the first write. `first`, `last` (days) or `months` say what is
        needed of a table kept by month: no other folder is listed or read."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        if not path_exists(self.spark, self._path(name)):
            return self.spark.createDataFrame([], schema)
        if name not in BY_MONTH:
            return self.spark.read.schema(schema).parquet(self._path(name)).select(schema.fieldNames())
        stored = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("load_month", T.StringType())])).parquet(self._path(name))
        if months is not None:
            stored = stored.where(F.col("load_month").isin(months))
        if first is not None:
            stored = stored.where((F.col("load_month") >= F.lit(f"{first:%Y-%m}")) & (F.col("load_date") >= F.lit(first)))
        if last is not None:
            stored = stored.where((F.col("load_month") <= F.lit(f"{last:%Y-%m}")) & (F.col("load_date") <= F.lit(last)))
        return stored.select(schema.fieldNames())

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the (day, table) pairs, or the publication, present in `df`."""
        new = df.select(T.StructType.fromDDL(SCHEMAS[name]).fieldNames())
        if name not in BY_MONTH:
            self._write(new, name, ["seq"])
            return
        if not path_exists(self.spark, self._path(name)):
            self._write(new.withColumn("load_month", F.date_format("load_date", "yyyy-MM")), name, ["load_month"])
            return
        key = ["load_date", "table"]
        new = stage(new, name)
        months = [r[0] for r in new.select(F.date_format("load_date", "yyyy-MM")).distinct().collect()]  # calendar months
        kept = self.read(name, months=months).join(new.select(*key).distinct(), key, "left_anti")
        self._write_months(kept.unionByName(new), name)

    def clear(self, name: str, days: DataFrame) -> None:
        """Drop the (load_date, table) pairs of `days` from a table kept by month; nothing happens where there are none."""
        gone = stage(days.select("load_date", "table").distinct(), "cleared")
        months = [r[0] for r in gone.select(F.date_format("load_date", "yyyy-MM")).distinct().collect()]
        held = self.read(name, months=months)
        if not held.join(gone, ["load_date", "table"], "left_semi").isEmpty():
            left = stage(held.join(gone, ["load_date", "table"], "left_anti").withColumn("load_month", F.date_format("load_date", "yyyy-MM")), name)
            remaining = {r[0] for r in left.select("load_month").distinct().collect()}
            self._write(left, name, ["load_month"])
            self._drop(name, [f"load_month={m}" for m in months if m not in remaining])

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a log nobody rewrites."""
        df.select(T.StructType.fromDDL(SCHEMAS[name]).fieldNames()).coalesce(1).write.mode("append").parquet(self._path(name))

    def drop_publications(self, name: str, before: date, needed: DataFrame) -> None:
        """Drop the folders of publications all of whose rows are older than `before`, but for those `needed` names."""
        kept = {r["seq"] for r in needed.collect()}  # publications with an unfinished or recent incident
        last = self.read(name).groupBy("seq").agg(F.max("load_date").alias("d")).where(F.col("d") < F.lit(before))
        self._drop(name, [f"seq={r['seq']}" for r in last.select("seq").collect() if r["seq"] not in kept])

    def _write_months(self, df: DataFrame, name: str) -> None:
        merged = stage(df, name)  # also read from the partitions about to be replaced
        self._write(merged.withColumn("load_month", F.date_format("load_date", "yyyy-MM")), name, ["load_month"])

    # ---------------------------------------------------------------- rows
    def write_load(self, df: DataFrame, spec: TableSpec, days: list[date] | None = None) -> None:
        """Rows tagged with `load_date` replace those of the same days. `days` names the delivered days, so that
        one that now brings no row loses its old ones. The source is read once: what was written is listed."""
        part = f"load-{uuid.uuid4().hex}"
        self._add_rows(df, spec, part, one_day=days is not None and len(days) <= 1)
        name = f"rows/{spec.name}"
        for day in self.partition_days(name):
            parts = self._partitions(f"{name}/load_date={day.isoformat()}")
            if f"part={part}" in parts or day in (days or ()):
                self._drop(f"{name}/load_date={day.isoformat()}", [p for p in parts if p != f"part={part}"])

    def add_batch(self, batch: DataFrame, spec: TableSpec, batch_id: int, publication: str) -> None:
        """Rows of one batch of a stream. `publication` is the column that orders the publications: within one, the batches of
        a day add up; a later one replaces the day, and rows of an earlier one that come late are left out. A batch that is
        repeated replaces itself."""
        name = f"rows/{spec.name}"
        held = stage(batch, "batch")
        found = held.select("load_date", F.col(publication).cast("string").alias("p")).groupBy("load_date").agg(F.max("p").alias("p"))
        newest = {r["load_date"]: r["p"] or "" for r in found.where("load_date is not null").collect()}  # calendar days
        known = set(self.partition_days(name))
        current = {}
        for day, mine in newest.items():
            parts = self._partitions(f"{name}/load_date={day.isoformat()}") if day in known else []
            older = [_publication_of(p) for p in parts]
            current[day] = max([mine, *(p for p in older if p is not None)])
        wanted = self.spark.createDataFrame([(d, p) for d, p in current.items()], "load_date date, __wanted string")
        keep = held.join(F.broadcast(wanted), "load_date").where(F.coalesce(F.col(publication).cast("string"), F.lit("")) == F.col("__wanted"))
        by_publication: dict[str, list[date]] = {}
        for day, p in current.items():
            by_publication.setdefault(p, []).append(day)
        for p, days in by_publication.items():
            part = f"stream-{p.encode().hex()}-{batch_id:010d}"
            self._add_rows(keep.where(F.col("load_date").isin(days)), spec, part)
            for day in days:
                folder = f"{name}/load_date={day.isoformat()}"
                gone = [x for x in self._partitions(folder) if _publication_of(x) != p]
                if newest[day] == p:
                    self._drop(folder, gone)

    def _add_rows(self, df: DataFrame, spec: TableSpec, part: str, one_day: bool = False) -> None:
        columns = [F.col(f"`{c}`") for c in spec.column_names if c != "load_date"]
        self._write(df.select(*columns, "load_date", F.lit(part).alias("part")), f"rows/{spec.name}", ["load_date", "part"], one_day)

    def rows(self, spec: TableSpec) -> DataFrame:
        fields = [*stored_schema(spec).fields, T.StructField("load_date", T.DateType())]
        if not path_exists(self.spark, self._path(f"rows/{spec.name}")):
            return self.spark.createDataFrame([], T.StructType(fields))
        stored = self.spark.read.schema(T.StructType([*fields, T.StructField("part", T.StringType())])).parquet(self._path(f"rows/{spec.name}"))
        return stored.drop("part")

    # ----------------------------------------------------------- retention
    def _drop(self, name: str, partitions: list[str]) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for p in partitions:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/{p}"), True)

    def _partitions(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if "=" in n)

    def partition_days(self, name: str) -> list[date]:
        """Load dates of a row table from its partition folders: no file is read."""
        return [date.fromisoformat(n.split("=", 1)[1]) for n in self._partitions(name)]

    def apply_retention(self, specs: list[TableSpec], today: date, days_rows: int = DAYS_ROWS, days_history: int = DAYS_HISTORY,
                        validated: list[date] | None = None) -> None:
        """Drop rows older than `days_rows` and, when a validated day (`today` by default) is the first of a month, metrics, check
        results and examples older than `days_history` on the last such day. Whole folders go; only the month that holds the
        limit is rewritten."""
        for spec in specs:
            name = f"rows/{spec.name}"
            self._drop(name, [f"load_date={d.isoformat()}" for d in self.partition_days(name)
                              if d < today - timedelta(days=days_rows)])
        firsts = [d for d in (validated or [today]) if d.day == 1]
        if not firsts:
            return
        limit = max(firsts) - timedelta(days=days_history)
        for name in ("metrics", "check_results", "examples", "profiles"):
            folders = self._partitions(name)
            edge = f"load_month={limit:%Y-%m}"
            if edge in folders:
                month = self.read(name, months=[f"{limit:%Y-%m}"])
                kept = month.where(F.col("load_date") >= F.lit(limit))
                if kept.isEmpty():
                    self._drop(name, [edge])
                else:
                    self._write_months(kept, name)
            self._drop(name, [f for f in folders if f < edge])


def _publication_of(part: str) -> str | None:
    """The publication of a stream's folder; None for a folder of a whole load."""
    pieces = part.removeprefix("part=").split("-")
    return bytes.fromhex(pieces[1]).decode() if pieces[0] == "stream" else None


def keep_rows(df: DataFrame, today, days: int) -> DataFrame:
    """The rows retention keeps, as a filter on `load_date` (a partition filter on a stored table)."""
    return df.where(F.col("load_date") >= F.date_sub(today, days))
