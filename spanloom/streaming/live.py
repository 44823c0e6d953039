"""The event index as it arrives: windowed counts, runs of events and an idempotent append, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, key: list[str], width: str, late: str) -> DataFrame:
    """(start, key, n) of each window of `width`; events later than `late` behind the latest one are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *key, "n")


def live_sessions(events: DataFrame, time: str, key: list[str], gap: str, late: str) -> DataFrame:
    """(key, start, last, n): runs of events no more than `gap` apart, each sent once it can't grow any more."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return rows.select(*key, F.col("w.start").alias("start"), "last", "n")


def first_seen(events: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """Each natural key's first event; state of keys older than `late` is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def append_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own number, so that a batch run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
