"""Data-quality checks."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from shiftledger import schemas
from shiftledger.operators import quality

D = dt.date
H = Decimal


def test_hours_outside_the_range_or_missing(spark, rows):
    targets = spark.createDataFrame([(1, H("3.9")), (2, H("4.0")), (3, H("7.0")), (4, None)], "id bigint, target_hour decimal(5,1)")
    assert rows(quality.hour_out_of_range(targets, 4, 7), "id") == [(1,), (4,)]


def test_bad_date_ranges(spark, rows):
    requests = spark.createDataFrame(
        [(1, D(2024, 5, 2), D(2024, 5, 1)), (2, D(2024, 4, 1), D(2024, 5, 1)), (3, D(2024, 5, 1), D(2024, 5, 1))],
        "id bigint, start_date date, end_date date",
    )
    assert rows(quality.bad_date_ranges(requests, D(2024, 5, 1)), "id", "reason") == [
        (1, "end_before_start"),
        (2, "start_before_as_of"),
    ]


def test_duplicate_keys(spark, rows):
    table = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id bigint, k string")
    assert rows(quality.duplicate_keys(table, ["id", "k"])) == [(1, "a", 2)]


def test_bad_text_tells_every_reason(spark):
    raw = spark.createDataFrame(
        [("1", "Ann", "2024-05-01", "6"), ("x", "A very long name", "1 May", "six"), (None, "Bo", None, None)],
        "staff_id string, staff_name string, appt_date string, target_hour string",
    )
    found = quality.bad_text(
        raw, schemas.TARGET, required=["staff_id"], max_length={"staff_name": 10}, letters_only=["staff_name"]
    )
    assert {r.staff_id: r.reasons for r in found.collect()} == {
        "x": "not_a_number:staff_id,not_a_date:appt_date,not_a_number:target_hour,too_long:staff_name,not_letters:staff_name",
        None: "missing:staff_id",
    }


def test_bad_ids(spark, rows):
    raw = spark.createDataFrame([("7",), ("0",), ("-1",), ("a",), (None,)], "id string")
    assert rows(quality.bad_ids(raw, "id")) == [(None,), ("-1",), ("0",), ("a",)]


def test_lines_of_a_day_collapse_to_their_sum(spark, rows):
    schema = T.StructType([f for f in schemas.TARGET_UPDATE if f.name in ("practitioner_id", "target_date", "target_hour")])
    raw = spark.createDataFrame([(1, D(2024, 8, 2), H("1.5")), (1, D(2024, 8, 2), H("2.5")), (1, D(2024, 8, 5), H("6"))], schema)
    assert rows(quality.collapse_daily_targets(raw)) == [(1, D(2024, 8, 2), H("4.0")), (1, D(2024, 8, 5), H("6.0"))]
