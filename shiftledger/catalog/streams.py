"""Streaming jobs, run over all events that are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger.catalog.base import query, same_as
from shiftledger.session import work_dir
from shiftledger.sources.mapping import Landing
from shiftledger.streaming import activity, merging


def run(t: Landing, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Weeks and sessions are cut in the zone of the session, which has to be UTC as the stored times are; the
    session gets its own zone back after the run."""
    folder = work_dir(t.spark, name)
    with in_utc(t):
        return activity.run_available(job(t.activity_stream()), f"{folder}/table", f"{folder}/checkpoint")


@contextmanager
def in_utc(t: Landing) -> Iterator[None]:
    zone = t.spark.conf.get("spark.sql.session.timeZone")
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        t.spark.conf.set("spark.sql.session.timeZone", zone)


@query(
    "stream_weekly_actuals",
    f"""
    SELECT week_start, practitioner_id, event_count, actual_hour
    FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id AS practitioner_id,
                 count(*) AS event_count, CAST(sum(CAST(value AS DECIMAL(10,2))) AS DECIMAL(20,2)) AS actual_hour
          FROM events GROUP BY ALL)
    WHERE week_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL {p.STREAM_DELAY}""",
)
def stream_weekly_actuals(t: Landing) -> DataFrame:
    """Hours per week and practitioner; the weeks that the watermark has closed."""
    return run(t, lambda stream: activity.weekly_actuals(stream, p.STREAM_DELAY), "weekly_actuals")


@query(
    "stream_activity_sessions",
    f"""
    SELECT session_start, session_end, practitioner_id, event_count
    FROM (SELECT practitioner_id, min(ts) AS session_start, max(ts) + INTERVAL {p.SESSION_GAP} AS session_end,
                 count(*) AS event_count
          FROM (SELECT *, sum(opens) OVER (PARTITION BY practitioner_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n
                FROM (SELECT user_id AS practitioner_id, ts,
                             CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                       <= INTERVAL {p.SESSION_GAP} THEN 0 ELSE 1 END AS opens
                      FROM events))
          GROUP BY practitioner_id, n)
    WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL {p.SESSION_DELAY}""",
)
def stream_activity_sessions(t: Landing) -> DataFrame:
    """Sessions of practitioners; those that the watermark has closed."""
    return run(t, lambda stream: activity.sessions(stream, p.SESSION_DELAY, p.SESSION_GAP), "sessions")


@same_as("stream_activity_sessions", "stream_sessions_by_slice")
def stream_sessions_by_slice(t: Landing) -> DataFrame:
    """The same sessions, first cut within slices of time and then stitched."""
    folder = work_dir(t.spark, "sessions_by_slice")
    with in_utc(t):
        merging.run_available(t.activity_stream(), merging.sessions(p.SESSION_GAP), folder, p.SESSION_DELAY)
        start, end = (F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end"))
        found = merging.closed(t.spark, folder)
        return found.select(start.alias("session_start"), end.alias("session_end"), "practitioner_id", "event_count")


_ARRIVED = f"""
    SELECT *, user_id AS practitioner_id, date_trunc('week', ts) + INTERVAL 7 DAY AS week_end,
           max(CASE WHEN batch = 0 THEN ts END) OVER () - INTERVAL {p.STREAM_DELAY} AS mark
    FROM (SELECT *, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM events)"""


@query(
    "stream_weekly_late_rows",
    f"""
    SELECT CAST(week_end AS DATE) AS week_end, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late,
           CAST(coalesce(sum(CAST(value AS DECIMAL(10,2))) FILTER (late), 0) AS DECIMAL(20,2)) AS late_hours
    FROM (SELECT *, batch = 1 AND week_end <= mark AS late FROM ({_ARRIVED})) GROUP BY ALL""",
)
def stream_weekly_late_rows(t: Landing) -> DataFrame:
    """Events of a tenth of the users arrive a batch after the others: per week the rows that counted, in closed and
    open weeks, and the late ones with their hours."""
    folder = work_dir(t.spark, "weekly_late_rows")
    with in_utc(t):
        slow = F.col("practitioner_id") % 10 == 0
        job = merging.weeks()
        for batch, rows in enumerate((t.activity().where(~slow), t.activity().where(slow))):
            merging.step(rows, batch, job, folder, p.STREAM_DELAY)
        late = merging.late(t.spark, folder).groupBy(F.date_trunc("week", "ts").alias("window_start")).agg(
            F.count("*").alias("late"), F.sum("actual_hour").alias("late_hours")
        )
        kept = merging.counted(t.spark, folder).groupBy("window_start").agg(F.sum("event_count").alias("kept"))
        both = kept.join(late, "window_start", "full")
        zero = F.lit(0).cast("bigint")
        return both.select(
            F.date_add(F.col("window_start").cast("date"), 7).alias("week_end"),
            F.coalesce("kept", zero).alias("kept"),
            F.coalesce("late", zero).alias("late"),
            F.coalesce("late_hours", F.lit(0)).cast("decimal(20,2)").alias("late_hours"),
        )
