"""A stream of file changes: debounced by sessions of quiet, the last change of a session deciding, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

QUIET = "2 seconds"
LATE = "10 seconds"
SCHEMA = "event_id long, ts timestamp, path string, op string"


def change_events(events: DataFrame) -> DataFrame:
    """SCHEMA from the events table: a user is a path, error removes, signup creates, all else writes."""
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "create").otherwise("write")
    # streams need an instant, not a local time
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), op.alias("op"))


def sessions(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(path, first_us, last_us, n_events, action): runs of changes of a path with less than `quiet` between them; action is delete if the last one removed it, else upsert. Batch or stream alike."""
    last = F.max_by("op", F.struct("ts", "event_id"))
    g = changes.groupBy("path", F.session_window("ts", quiet)).agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count("*").alias("n_events"), last.alias("op"))
    return g.select("path", F.unix_micros("f").alias("first_us"), F.unix_micros("l").alias("last_us"), "n_events", F.when(F.col("op") == "remove", "delete").otherwise("upsert").alias("action"))


def read_changes(spark: SparkSession, folder: str, late: str = LATE) -> DataFrame:
    """The stream of change files (Parquet of SCHEMA) that arrive in a folder; changes later than `late` are dropped."""
    return spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("ts", late)


def start_sync(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, once: bool = False) -> StreamingQuery:
    """Starts a stream that hands each batch of finished sessions to apply(sessions, batch_id). A batch may come again after a failure with the same id: apply has to give the same result then."""
    w = sessions(changes, quiet).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (w.trigger(availableNow=True) if once else w).start()


def split_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to delete, paths to index again) of a batch, each path once, by its last session."""
    last = batch.groupBy("path").agg(F.max_by("action", "last_us").alias("action"))
    return last.where("action = 'delete'").select("path"), last.where("action = 'upsert'").select("path")
