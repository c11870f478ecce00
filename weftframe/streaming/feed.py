"""Fold an event feed into per-key state, as a stream or as a batch.

Every fold is an aggregation over ``(order, kind)``, so it gives the same table
however the events are cut into batches and in whatever order they arrive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError
from weftframe.operators.history import latest_per_key
from weftframe.session import scratch_path

# Event kinds and the state each one leaves behind.
STATES = {
    "started": "Running",
    "progress": "Running",
    "completed": "Completed",
    "failed": "Failed",
    "cancelled": "Cancelled",
}
TERMINAL = ("completed", "failed", "cancelled")


def with_kind(events: DataFrame, kinds: Mapping[str, str], column: str = "event_type") -> DataFrame:
    """Add ``kind`` (started, progress, completed, failed or cancelled)."""
    pairs = [F.lit(x) for pair in kinds.items() for x in pair]
    return events.withColumn("kind", F.try_element_at(F.create_map(*pairs), F.col(column)))


def _last(value: Column, among: Column, order: Column) -> Column:
    """Value at the last event among those that set it."""
    return F.max_by(value, F.when(among, order))


def _state() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.col("kind"))


def latest_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, duration: str, error: str):
    """State, times, duration and error per key after its last event.

    A start clears the end time and the error; an end sets them. Progress after
    an end means running again but keeps the old end time.
    """
    at = F.struct(*order)
    kind = F.col("kind")
    ends = kind.isin(*TERMINAL)
    starts = kind == "started"
    return events.where(kind.isNotNull()).groupBy(*keys).agg(
        F.max_by(_state(), at).alias("state"),
        _last(F.col(ts), starts, at).alias("started_at"),
        _last(F.when(ends, F.col(ts)), starts | ends, at).alias("completed_at"),
        _last(F.col(duration), ends, at).alias("duration"),
        _last(F.when(kind == "failed", F.col(error)), starts | (kind == "failed"), at).alias("error"),
        F.count(F.lit(1)).alias("events"),
    )


def node_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], duration: str, error: str) -> DataFrame:
    """State, duration and error of the last event per node; a newer event
    replaces all three."""
    at = F.struct(*order)
    ends = F.col("kind").isin(*TERMINAL)
    failed = F.col("kind") == "failed"
    return events.where(F.col("kind").isNotNull()).groupBy(*keys).agg(
        F.max_by(
            F.struct(
                _state().alias("state"),
                F.when(ends, F.col(duration)).alias("duration"),
                F.when(failed, F.col(error)).alias("error"),
            ),
            at,
        ).alias("last")
    ).select(*keys, "last.state", "last.duration", "last.error")


def lifecycle_counters(events: DataFrame) -> DataFrame:
    """One row with the number of starts, ends by outcome."""
    return events.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("started", "completed", "failed", "cancelled")]
    )


def active_gauge(counters: DataFrame) -> DataFrame:
    """Starts minus ends, never below zero, from the lifecycle counters."""
    ended = F.col("completed") + F.col("failed") + F.col("cancelled")
    return counters.select(F.greatest(F.col("started") - ended, F.lit(0)).alias("active"))


def progress_percent(nodes: DataFrame, run: Sequence[str]) -> DataFrame:
    """Completed nodes of each run in percent, rounded down."""
    done = F.count_if(F.col("state") == "Completed")
    total = F.count(F.lit(1))
    percent = F.when(total == 0, 100).otherwise(F.floor(done * 100.0 / total)).cast("int")
    return nodes.groupBy(*run).agg(percent.alias("progress"))


# States in the order they are reported.
NODE_STATES = ("Pending", "Running", "Completed", "Failed", "Cancelled", "Retrying")


def state_counts(nodes: DataFrame) -> DataFrame:
    """One row with the number of nodes in each state."""
    return nodes.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in NODE_STATES])


def log_level(text: Column) -> Column:
    """Level of a log line by the words in it."""
    line = F.lower(text)
    return (
        F.when(line.contains("failed") | line.contains("error"), "Error")
        .when(line.contains("cancel"), "Warning")
        .when(line.contains("started"), "Debug")
        .otherwise("Info")
    )


def filter_feed(
    states: DataFrame,
    min_duration: float | None = None,
    sort: str = "Started",
    descending: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Rows of at least a duration, sorted by start, duration, state or key.

    ``key`` is the column that names the run; it also decides between ties.
    """
    rows = states
    if min_duration is not None:
        rows = rows.where(F.coalesce(F.col("duration"), F.lit(0.0)) >= min_duration)
    if sort == "Key" and key is None:
        raise TransformError("sorting by key needs the key column")
    column = {
        "Duration": F.coalesce(F.col("duration"), F.lit(0.0)),
        "State": F.col("state"),
        "Key": F.coalesce(F.col(key).cast("string"), F.lit("")) if key else None,
    }.get(sort, F.col("started_at"))
    ties = [F.col(key)] if key else []
    return rows.orderBy(column.desc() if descending else column.asc(), *ties)


# --- running a fold as a stream ----------------------------------------------


def read_feed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None):
    """A stream over the parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table_feed(spark: SparkSession, path: str):
    """A stream over a parquet table, be it one file or a folder of parts. A missing table is an error."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(table).isDirectory():
        return reader.parquet(path)
    # a stream reads folders: this one file of its folder, and none with a longer name
    name = re.sub(r"([\\*?\[\]{}])", r"\\\1", table.getName())
    return reader.option("pathGlobFilter", name).parquet(table.getParent().toString())


def fold_stream(
    stream: DataFrame,
    fold: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run a fold over everything the stream has now; returns its table.

    Each batch writes the keys it changed under its own batch folder, so a
    repeated batch overwrites itself. Reading takes the newest row per key.
    Pass the same two paths again to go on where the last call stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "feed")
    checkpoint = checkpoint or scratch_path(spark, "feed-checkpoint")
    folded = fold(stream)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        folded.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*folded.schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        changelog = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], folded.schema)  # no event came yet
    return current_state(changelog, keys)


def current_state(changelog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a change log with ``batch_id``."""
    if not keys:
        newest = changelog.agg(F.max("batch_id").alias("_b")).scalar()
        return changelog.where(F.col("batch_id") == newest).drop("batch_id")
    return latest_per_key(changelog, keys, ["batch_id"]).drop("batch_id")
