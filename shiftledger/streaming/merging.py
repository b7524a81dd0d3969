"""Streaming jobs that keep open windows as a stored table and report late rows.

Each micro-batch is first summed by itself, with sums that can be merged, and then merged with the windows that are
still open. The first step groups by more than the person (sessions also by a slice of time), so the events of one busy
person are spread over tasks; what is merged per person are a few rows per slice. Windows behind the watermark are
closed and appended. Rows that come behind the watermark are not lost from sight: they go to a table of their own, so that
kept and late rows add up to all rows.

The watermark is the newest event time of the batches before, less the delay, as in the built-in aggregates. A batch
writes its closed windows and late rows as its own partition and commits the open windows with the newest time last
(``sources/tables.py``); a batch that runs again starts from the state before it and overwrites its own partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.sources import tables


@dataclass(frozen=True)
class Job:
    """``sums`` turns events into mergeable rows with ``window_start`` and ``window_end``, ``merge`` merges such rows.
    ``ends`` is the end of the window that an event alone would have."""

    sums: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    ends: Column


def weeks() -> Job:
    """Events and hours per Monday week and practitioner."""
    start = F.date_trunc("week", "ts")
    keys = ("window_start", "window_end", "practitioner_id")

    def sums(events: DataFrame) -> DataFrame:
        marked = events.withColumns({"window_start": start, "window_end": start + F.expr("INTERVAL 7 DAYS")})
        return marked.groupBy(*keys).agg(
            F.count("*").alias("event_count"), F.sum("actual_hour").cast("decimal(20,2)").alias("actual_hour")
        )

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum("event_count").alias("event_count"), F.sum("actual_hour").cast("decimal(20,2)").alias("actual_hour")
        )

    return Job(sums, merge, start + F.expr("INTERVAL 7 DAYS"))


def sessions(gap: str, slice_seconds: int = 3600) -> Job:
    """Sessions per practitioner, first within slices of time, then stitched where they touch across slices."""

    def grouped(rows: DataFrame, window: Column, count: Column, *more: Column) -> DataFrame:
        return (
            rows.groupBy(window.alias("w"), "practitioner_id", *more)
            .agg(count.alias("event_count"))
            .select(
                F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "practitioner_id", "event_count"
            )
        )

    def sums(events: DataFrame) -> DataFrame:
        part = F.floor(F.unix_seconds("ts") / slice_seconds).alias("slice")
        return grouped(events, F.session_window("ts", gap), F.count("*"), part)

    def merge(rows: DataFrame) -> DataFrame:
        length = F.unix_micros("window_end") - F.unix_micros("window_start")
        own = F.concat(length.cast("string"), F.lit(" microseconds"))
        return grouped(rows, F.session_window("window_start", own), F.sum("event_count"))

    return Job(sums, merge, F.col("ts") + F.expr(f"INTERVAL {gap}"))


def run_available(stream: DataFrame, job: Job, folder: str, delay: str) -> None:
    """Process all data that is there, batch by batch."""
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: step(rows, batch, job, folder, delay))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def closed(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that the watermark has closed."""
    return spark.read.parquet(f"{folder}/closed").drop("batch")


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """The closed windows and, as far as they are known, the open ones."""
    done = closed(spark, folder)
    return done.unionByName(tables.read_table(spark, f"{folder}/open", done.schema))


def late(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came behind the watermark, with the batch that they came in."""
    return spark.read.parquet(f"{folder}/late")


def step(events: DataFrame, batch: int, job: Job, folder: str, delay: str) -> None:
    """One micro-batch."""
    spark = events.sparkSession
    path = f"{folder}/open"
    before = tables.manifest(spark, path, before=batch + 1)
    newest = before.notes.get("newest") if before else None
    behind = job.ends <= _watermark(newest, delay) if newest else F.lit(False)

    _own(events.where(behind), f"{folder}/late", batch)
    fresh = job.sums(events.where(~behind))
    known = tables.read_manifest(spark, path, fresh.schema, before) if before else None
    merged = job.merge(known.unionByName(fresh) if known else fresh)
    here = events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest")).first()["newest"]
    newest = max(x for x in (newest, here) if x) if newest or here else None
    done = F.col("window_end") <= _watermark(newest, delay) if newest else F.lit(False)
    parts = tables.write_parts(merged, path, F.when(done, "closed").otherwise("open"))  # computed once for both
    whole = tables.Manifest(batch + 1, {k: v for k, v in parts.items() if k == "closed"})
    _own(tables.read_manifest(spark, path, merged.schema, whole), f"{folder}/closed", batch)
    notes = {"newest": newest} if newest else {}
    tables.commit(spark, path, tables.Manifest(batch + 1, {k: v for k, v in parts.items() if k == "open"}, notes))
    tables.retire(spark, path, keep=2)


def _watermark(newest: str, delay: str) -> Column:
    return F.lit(dt.datetime.fromisoformat(newest).isoformat(sep=" ")).cast("timestamp") - F.expr(f"INTERVAL {delay}")


def _own(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch's own rows, in place of those of an earlier run of the batch."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
