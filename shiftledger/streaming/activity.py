"""Structured Streaming jobs over the activity table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_actuals(activity: DataFrame, delay: str) -> DataFrame:
    """Actual hours per Monday week and practitioner; rows later than ``delay`` are dropped.

    Windows count from the epoch, a Thursday; four days more start them on Monday.
    """
    return (
        activity.withWatermark("ts", delay)
        .groupBy(F.window("ts", "7 days", "7 days", "4 days"), "practitioner_id")
        .agg(F.count("*").alias("event_count"), F.sum("actual_hour").alias("actual_hour"))
        .select(
            F.col("window.start").cast("date").alias("week_start"),
            "practitioner_id",
            "event_count",
            "actual_hour",
        )
    )


def sessions(activity: DataFrame, delay: str, gap: str) -> DataFrame:
    """Activity sessions per practitioner, closed after ``gap`` without an event."""
    return (
        activity.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "practitioner_id")
        .agg(F.count("*").alias("event_count"))
        .select(
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
            "practitioner_id",
            "event_count",
        )
    )


def run_available(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Process all data that is there into a Parquet table and return the table.

    The checkpoint lies in the shared folder, so a restarted run goes on where the last one ended.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)
