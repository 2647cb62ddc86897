"""Event-time views of the audit stream; each works on batch and streaming tables alike.

Input is (ts, source_unit_id, action).  On a stream the watermark bounds the state: events later than it
are left out, and a window is emitted once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    found = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("window_start"), "action", "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    found = _timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "action").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("window_start"), "action", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    found = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "source_unit_id").agg(F.count("*").alias("n"))
    return found.select("source_unit_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_events(spark: SparkSession, folder: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number of them in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def write_parquet(found: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there, appended exactly once, then stop."""
    return (
        found.writeStream.outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(batches: DataFrame, state_folder: str, checkpoint: str, apply) -> StreamingQuery:
    """Fold micro-batches into versioned snapshots: ``apply(state, batch)`` makes each from the one before.

    A repeated batch writes the version it wrote before, so restarts change nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{state_folder}/v={number - 1}"
        state = spark.read.parquet(before) if number else None
        apply(state, batch).write.mode("overwrite").parquet(f"{state_folder}/v={number}")

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
