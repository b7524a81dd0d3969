"""Streams give what a batch gives for closed windows."""

import datetime as dt
from decimal import Decimal

import pytest

from shiftledger import session
from shiftledger.streaming import activity

SCHEMA = "ts timestamp, practitioner_id bigint, actual_hour decimal(10,2)"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def source(spark, tmp_path):
    """A folder that takes one file per call and is read one file per micro-batch, oldest first."""
    folder = tmp_path / "activity"
    folder.mkdir()
    count = 0

    def add(*rows):
        nonlocal count
        part = str(tmp_path / f"part-{count}")
        spark.createDataFrame([(ts, i, Decimal(h)) for ts, i, h in rows], SCHEMA).coalesce(1).write.parquet(part)
        data = next((tmp_path / f"part-{count}").glob("*.parquet"))
        (folder / f"{count}.parquet").write_bytes(data.read_bytes())
        count += 1

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return add, stream


def test_weeks_close_with_the_watermark_and_late_rows_are_dropped(source, tmp_path, rows):
    add, stream = source
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    add((at(1), 1, "2.5"), (at(7, 23, 59), 1, "1.0"), (at(8), 1, "4.0"))
    add((at(20), 2, "3.0"))
    run = lambda: activity.run_available(activity.weekly_actuals(stream(), "1 day"), table, checkpoint)
    assert rows(run()) == [
        (dt.date(2024, 1, 1), 1, 2, Decimal("3.50")),
        (dt.date(2024, 1, 8), 1, 1, Decimal("4.00")),
    ]
    # A restart goes on from the checkpoint: the late row of the first week changes nothing.
    add((at(2), 1, "9.0"), (at(30), 2, "1.0"))
    assert rows(run()) == [
        (dt.date(2024, 1, 1), 1, 2, Decimal("3.50")),
        (dt.date(2024, 1, 8), 1, 1, Decimal("4.00")),
        (dt.date(2024, 1, 15), 2, 1, Decimal("3.00")),
    ]


def test_sessions_end_after_the_gap(source, tmp_path, rows):
    add, stream = source
    add((at(1, 9), 1, "1"), (at(1, 9, 15), 1, "1"), (at(1, 9, 31), 1, "1"), (at(1, 9, 5), 2, "1"))
    add((at(2), 3, "1"))
    found = activity.run_available(
        activity.sessions(stream(), "1 hour", "15 minutes"), str(tmp_path / "t"), str(tmp_path / "c")
    )
    assert rows(found, "practitioner_id", "session_start", "session_end", "event_count") == [
        (1, at(1, 9), at(1, 9, 30), 2),
        (1, at(1, 9, 31), at(1, 9, 46), 1),
        (2, at(1, 9, 5), at(1, 9, 20), 1),
    ]


def test_work_folder_comes_from_the_session(spark, shared_folder):
    first, second = session.work_dir(spark, "x"), session.work_dir(spark, "x")
    assert first.startswith(shared_folder + "/x-") and first != second
