"""Streams into partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_into(table, stream: DataFrame, checkpoint: str, drop_late_before: int | None = None, **trigger):
    """Start a query that appends a stream's micro-batches to a table.

    A batch is committed under its number and the query's checkpoint, so a batch that is run again after a failure
    is added once. Late rows go to their windows, whenever they come; with ``drop_late_before`` (epoch seconds) rows
    of windows that have expired by then are left out.
    """
    spec = table.spec

    def add(rows: DataFrame, number: int) -> None:
        if drop_late_before is not None and spec.lifetime is not None:
            routed = table._routed(rows)
            rows = routed.filter(F.col("_p") + spec.interval + spec.lifetime > drop_late_before).drop("_p")
        table.append(rows, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, partition: str, interval_seconds: int, lateness: str | None = None) -> DataFrame:
    """(p, row_count): rows of each tumbling window of a stream, with a watermark if a lateness is given."""
    rows = stream.withWatermark(partition, lateness) if lateness else stream
    grouped = rows.groupBy(F.window(partition, f"{interval_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("row_count"))
    return grouped.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("p"), "row_count")


def sliding_counts(stream: DataFrame, partition: str, interval_seconds: int, slide_seconds: int, lateness: str | None = None) -> DataFrame:
    """(p, row_count): rows of each window of a stream that starts every ``slide_seconds``."""
    rows = stream.withWatermark(partition, lateness) if lateness else stream
    grouped = rows.groupBy(F.window(partition, f"{interval_seconds} seconds", f"{slide_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("row_count"))
    return grouped.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("p"), "row_count")


def session_counts(stream: DataFrame, partition: str, gap_seconds: int, *keys: str, lateness: str | None = None) -> DataFrame:
    """The keys, began, ended and row_count of each session: rows that follow each other within ``gap_seconds``."""
    rows = stream.withWatermark(partition, lateness) if lateness else stream
    grouped = rows.groupBy(*keys, F.session_window(partition, f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("row_count"))
    return grouped.select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "row_count")
