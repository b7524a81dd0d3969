"""Streams that merge open windows: equal to the built-in ones, late rows counted, batches safe to run again."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from shiftledger.sources import tables
from shiftledger.streaming import activity, merging

SCHEMA = "ts timestamp, practitioner_id bigint, actual_hour decimal(10,2)"
START = dt.datetime(2024, 1, 1)
GAP = dt.timedelta(minutes=15)


@pytest.fixture(scope="module")
def events():
    """Half of all events are of one user; times go on over the batches, with a few far behind."""
    rng = random.Random(2)
    batches = []
    for k in range(4):
        batch = []
        for _ in range(250):
            user = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
            late = rng.random() < 0.05
            minute = rng.randrange(0, 600) if late else 600 * k + rng.randrange(0, 700)
            batch.append((START + dt.timedelta(minutes=minute), user, Decimal("1.5")))
        batches.append(batch)
    return batches


def expected_sessions(batches, delay):
    """Sessions merged batch by batch, in plain Python."""
    windows, newest, closed, late = [], None, [], 0
    for batch in batches:
        for ts, user, _ in batch:
            if newest and ts + GAP <= newest - delay:
                late += 1
            else:
                windows.append((user, ts, ts + GAP, 1))
        newest = max([ts for ts, _, _ in batch] + ([newest] if newest else []))
        merged = []
        for user, start, end, n in sorted(windows):
            if merged and merged[-1][0] == user and start <= merged[-1][2]:
                merged[-1] = (user, merged[-1][1], max(end, merged[-1][2]), merged[-1][3] + n)
            else:
                merged.append((user, start, end, n))
        closed += [w for w in merged if w[2] <= newest - delay]
        windows = [w for w in merged if w[2] > newest - delay]
    return sorted(closed), sorted(windows), late


def test_sessions_over_batches(spark, tmp_path, events, rows):
    folder, job = str(tmp_path / "s"), merging.sessions("15 minutes")
    frames = [spark.createDataFrame(b, SCHEMA) for b in events]
    for batch, frame in enumerate(frames):
        merging.step(frame.repartition(3), batch, job, folder, "1 hour")
        if batch == 2:  # lost after its commit, so the stream runs it again
            merging.step(frame, batch, job, folder, "1 hour")
    closed, windows, late = expected_sessions(events, dt.timedelta(hours=1))
    cols = ("practitioner_id", "window_start", "window_end", "event_count")
    assert late > 5 and len(closed) > 50
    assert rows(merging.closed(spark, folder), *cols) == closed
    whole = merging.counted(spark, folder)
    assert rows(whole, *cols) == sorted(closed + windows)
    assert merging.late(spark, folder).count() == late
    assert sum(r.event_count for r in whole.collect()) + late == sum(map(len, events))
    assert len(tables.versions(spark, f"{folder}/open")) <= 2


def test_weeks_and_late_hours(spark, tmp_path, rows):
    folder, job = str(tmp_path / "w"), merging.weeks()
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    batches = [[(at(1), 1, "2.5"), (at(7, 23), 1, "1.0"), (at(8), 1, "4.0")], [(at(20), 2, "3.0")], [(at(2), 1, "9.0"), (at(30), 2, "1.0")], []]
    for k, batch in enumerate(batches):
        merging.step(spark.createDataFrame([(t, i, Decimal(h)) for t, i, h in batch], SCHEMA), k, job, folder, "1 day")
    assert rows(merging.closed(spark, folder), "window_start", "practitioner_id", "event_count", "actual_hour") == [
        (at(1), 1, 2, Decimal("3.50")), (at(8), 1, 1, Decimal("4.00")), (at(15), 2, 1, Decimal("3.00")),
    ]
    assert rows(merging.late(spark, folder), "ts", "actual_hour", "batch") == [(at(2), Decimal("9.00"), 2)]


def test_equal_to_the_built_in_stream_and_restarts(spark, tmp_path, events, rows):
    folder = tmp_path / "in"
    flat = [e for batch in events for e in batch]
    spark.createDataFrame(flat, SCHEMA).repartition(3).write.parquet(str(folder))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(folder))
    built_in = activity.run_available(
        activity.sessions(stream(), "1 hour", "15 minutes"), str(tmp_path / "t"), str(tmp_path / "c")
    )
    for _ in range(2):
        merging.run_available(stream(), merging.sessions("15 minutes"), str(tmp_path / "m"), "1 hour")
        found = merging.closed(spark, str(tmp_path / "m"))
        cols = ("window_start", "window_end", "practitioner_id", "event_count")
        assert rows(found, *cols) == rows(built_in, "session_start", "session_end", *cols[2:])


def test_a_busy_user_is_spread(spark):
    """The first grouping goes by slice as well, so one user's events reach several tasks, and few rows are merged."""
    many = spark.range(20_000).selectExpr(
        "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 30) AS ts", "id % 1 + 1 AS practitioner_id", "1.0BD AS actual_hour"
    )
    first = merging.sessions("15 minutes").sums(many)
    plan = first._jdf.queryExecution().executedPlan().toString()
    dealt = plan.split("hashpartitioning(")[1].split(")")[0]
    assert "practitioner_id" in dealt and "_groupingexpression" in dealt, "by person and slice"
    hours = defaultdict(int)
    for r in first.collect():
        hours[r.practitioner_id] += 1
    assert hours[1] == 167
    (only,) = merging.sessions("15 minutes").merge(first).collect()
    assert only.event_count == 20_000
