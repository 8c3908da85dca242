"""Publications and daily counts as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadwatch.model import VOLUME_Z, TableSpec
from loadwatch.session import shared_dir
from loadwatch.sources.publications import MANIFEST_SCHEMA, parse_manifest
from loadwatch.sources.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with lists and values needs the RocksDB provider; it also keeps large state out of the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def watch_publications(spark: SparkSession, folder: str, on_publication: Callable[[DataFrame, int], None],
                       checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Call `on_publication(manifest rows, batch id)` for each new manifest file of `folder`, in publication order.

    The checkpoint remembers the files seen: a restart neither repeats nor skips a publication.
    """
    files = spark.readStream.schema(MANIFEST_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", 1).json(folder)
    return (files.writeStream.foreachBatch(lambda batch, i: on_publication(parse_manifest(batch), i))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def stream_rows(rows: DataFrame, spec: TableSpec, store: Store, checkpoint: str, trigger: dict | None = None,
                publication: str | None = None) -> StreamingQuery:
    """Write streamed rows (tagged with `load_date`) to the store.

    A day may come in any number of files and batches: within a publication its rows add up. The column `publication` orders
    the publications (the time published, a run number as text); a later one replaces the days it brings. Without it all rows
    belong to one publication. A batch that is repeated after a failure replaces itself.
    """
    tagged = rows if publication else rows.withColumn("__publication", F.lit(""))

    def add(batch: DataFrame, batch_id: int) -> None:
        store.add_batch(batch, spec, batch_id, publication or "__publication")

    return (tagged.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def daily_counts(rows: DataFrame, time_column: str, table: str, load_type: str = "incremental",
                 delay: str = "1 hour") -> DataFrame:
    """Rows per day of a stream as volume series; a day is emitted once the watermark passes its end."""
    # Windows start at UTC midnight: shift the clock of the session onto UTC, so that days are those people see.
    at = F.from_utc_timestamp(F.col(time_column).cast("timestamp"), F.current_timezone())
    counted = rows.select(at.alias("at")).withWatermark("at", delay).groupBy(F.window("at", "1 day")).count()
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return counted.select(
        F.lit(table).alias("table"), F.lit("rows").alias("check_id"), day.alias("load_date"),
        F.col("count").cast("double").alias("value"), F.lit(VOLUME_Z).alias("z"),
        F.lit(load_type == "incremental").alias("same_weekday"), F.lit(True).alias("volume"))


def revise_counts(rows: DataFrame, time_column: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows per day of a stream, however late they come: every micro-batch writes the new counts of the days it changed as
    `revision=<batch>` of the table at `path`.

    The count is kept per day (a few bytes of state each, rows combined in every task first) and no watermark drops a row; a batch that is repeated replaces its own revision.
    """
    day = rows.select(F.col(time_column).cast("date").alias("load_date")).where("load_date is not null")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/revision={batch_id}")  # a row per changed day

    return (day.groupBy("load_date").agg(F.count(F.lit(1)).alias("row_count")).writeStream.outputMode("update").foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


REVISIONS = "load_date date, row_count bigint, revision bigint"


def revised_series(revisions: DataFrame, table: str, load_type: str = "incremental") -> DataFrame:
    """The revisions (a stream of them, or a table) as volume series for `stateful_bands`: a later revision of a day replaces its point."""
    return revisions.select(
        F.lit(table).alias("table"), F.lit("rows").alias("check_id"), "load_date", F.col("row_count").cast("double").alias("value"),
        F.lit(VOLUME_Z).alias("z"), F.lit(load_type == "incremental").alias("same_weekday"), F.lit(True).alias("volume"), "revision")


def latest_revisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each day (and other `keys`); `provisional`: no later day has been seen, so more rows are likely to come."""
    fields = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), "revision").alias("__last")).select(*keys, "__last.*")
    return last.withColumn("provisional", F.col("load_date") == last.agg(F.max("load_date")).scalar())


def run_to_table(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available, append to a Parquet table of the shared folder, and read it."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, label)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint or shared_dir(spark, f"{label}-checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
