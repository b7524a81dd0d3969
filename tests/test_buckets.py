"""Stored tables in buckets: joins without a shuffle, and days restated in place."""

import datetime as dt
from decimal import Decimal

import pytest

from shiftledger import schemas
from shiftledger.operators import aggregates, joins
from shiftledger.plans import colocated, facts
from shiftledger.sources import buckets, tables

D = dt.date
H = Decimal
LANDING = "staff_id bigint, location string, purchase_date date, actual_hour decimal(5,1), total decimal(12,2)"


@pytest.fixture(scope="module")
def landing(spark):
    def build(*rows):
        return spark.createDataFrame([(*r, H("2.0"), H("10.25")) for r in rows], LANDING)

    return build


@pytest.fixture(scope="module")
def target(spark):
    found = [(i, f"Staff {i}", D(2024, 5, d), H("6.0")) for i in (1, 2) for d in range(1, 20)]
    found += [(1, "Staff 1", D(2024, 5, 1), H("1.0")), (None, "Nobody", D(2024, 5, 1), H("1.0")), (2, "Staff 2", None, H("1.0"))]
    return spark.createDataFrame(found, schemas.TARGET)


ROWS = [(i, f"P{i % 2}", D(2024, m, d)) for i in (1, 2, 3) for m in (4, 5) for d in (1, 1, 2, 30)]
ROWS += [(None, "P1", D(2024, 5, 1)), (1, None, D(2024, 5, 1)), (1, "P0", D(2024, 5, 1)), (2, "P0", None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(tmp_path, landing, target):
    days, wanted = str(tmp_path / "person's days"), str(tmp_path / "targets")
    colocated.write_person_days(landing(*ROWS), days)
    colocated.write_day_targets(target, wanted)
    return days, wanted


def test_daily_join_moves_neither_side(spark, stored, landing, target, rows):
    found = colocated.daily_with_target(spark, *stored)
    assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
    cols = ("staff_id", "purchase_date", "location", "total_actual_hour", "total_billing", "target_hour")
    expected = joins.with_daily_target(aggregates.daily_actuals(landing(*ROWS)), target)
    assert rows(found, *cols) == rows(expected, *cols)


def test_fact_and_groupings_move_neither_side(spark, stored, landing, target, rows):
    daily = buckets.read_table(spark, stored[0], schemas.PERSON_DAYS)
    wanted = buckets.read_table(spark, stored[1], schemas.TARGET)
    assert "Exchange" not in plan(facts.with_targets(daily, buckets.beside(wanted)))
    people = spark.createDataFrame([(10 + i, i, True) for i in (1, 2, 3)], "practitioner_dim_id bigint, practitioner_id bigint, is_current boolean")
    places = spark.createDataFrame([(1, "P0", None), (2, "P1", None)], schemas.DIM_LOCATION)
    found = colocated.fact_performance(spark, *stored, people, places)
    assert rows(found) == rows(facts.fact_performance(landing(*ROWS), target, people, places))


def test_weekly_merge_moves_neither_side(spark, tmp_path, landing, rows):
    perf = landing(*ROWS).selectExpr("purchase_date appt_date", "staff_id practitioner_id", "actual_hour total_hours", "total total_income")
    goals = spark.createDataFrame(
        [(1, "A", 18, H("1.00"), H("5.0")), (1, "B", 18, H("2.00"), H("6.0")), (9, "A", 18, None, None)], schemas.WEEKLY_TARGET
    )
    weeks, wanted = str(tmp_path / "weeks"), str(tmp_path / "goals")
    colocated.write_weeks(perf, weeks)
    colocated.write_weekly_targets(goals, wanted)
    found = colocated.weekly_with_target(spark, weeks, wanted, "target_income", "target_hour")
    assert "Exchange" not in plan(found)
    expected = joins.with_weekly_target(aggregates.weekly_performance(perf, "practitioner_id"), goals, "target_income", "target_hour")
    assert rows(found) == rows(expected)


def test_restated_days_rewrite_their_months_only(spark, stored, landing, rows):
    path = stored[0]
    before = tables.manifest(spark, path)
    old = rows(buckets.read_table(spark, path, schemas.PERSON_DAYS))
    now = [r for r in ROWS if r[2] != D(2024, 5, 30)] + [(1, "P1", D(2024, 5, 2)), (7, "P7", D(2024, 6, 1))]
    days = [D(2024, 5, 2), D(2024, 5, 30), D(2024, 6, 1)]
    for _ in range(2):  # a repeated run gives the same
        colocated.restate_person_days(landing(*now), path, days)
        found = buckets.read_table(spark, path, schemas.PERSON_DAYS)
        assert rows(found) == rows(colocated.person_days(landing(*now)))
    after = tables.manifest(spark, path)
    assert {k for k in after.parts if before.parts.get(k) != after.parts[k]} == {"2024-05", "2024-06"}
    assert set(after.parts) == {"2024-04", "2024-05", "2024-06", tables.UNDATED}
    assert rows(buckets.read_table(spark, path, schemas.PERSON_DAYS, at=before.version)) == old, "readers of a version keep it"
    assert "Exchange" not in plan(colocated.daily_with_target(spark, *stored)), "parts of several versions stay in buckets"
    assert colocated.restate_person_days(landing(*now), path, []) is None
    # A month that has lost all its rows is gone.
    colocated.restate_person_days(landing(*ROWS), path, [D(2024, 6, 1)])
    assert "2024-06" not in tables.manifest(spark, path).parts


def test_reading_some_parts_prunes_the_others(spark, stored, rows):
    found = buckets.read_table(spark, stored[0], schemas.PERSON_DAYS, parts=["2024-04"])
    assert {r[0].month for r in rows(found, "purchase_date")} == {4}
    assert "PartitionFilters: []" not in plan(found) and "stored_part" in plan(found)


def test_a_busy_person_spreads_over_buckets(spark, tmp_path):
    busy = spark.range(400).selectExpr(
        "1L staff_id", "'P' location", "date_add(date'2024-01-01', int(id)) purchase_date",
        "cast(1 as decimal(5,1)) actual_hour", "cast(1 as decimal(12,2)) total",
    )
    path = str(tmp_path / "busy")
    colocated.write_person_days(busy, path, 4)
    found = buckets.read_table(spark, path, schemas.PERSON_DAYS)
    per_bucket = [r["count"] for r in found.selectExpr("pmod(hash(staff_id, purchase_date), 4) b").groupBy("b").count().collect()]
    assert len(per_bucket) == 4 and max(per_bucket) < 200


def test_lost_and_empty_writes(spark, tmp_path, landing, rows):
    path = str(tmp_path / "days")
    assert buckets.read_table(spark, path, schemas.PERSON_DAYS).count() == 0
    layout = buckets.Layout(("staff_id", "purchase_date"), 2)
    buckets.write_parts(colocated.person_days(landing(*ROWS)), path, layout, tables.month("purchase_date"))  # lost before its commit
    assert buckets.read_table(spark, path, schemas.PERSON_DAYS).count() == 0
    colocated.write_person_days(landing(*ROWS).where("false"), path, 2)
    assert buckets.read_table(spark, path, schemas.PERSON_DAYS).count() == 0
    colocated.restate_person_days(landing(*ROWS[:3]), path, [ROWS[0][2], ROWS[2][2]])
    assert rows(buckets.read_table(spark, path, schemas.PERSON_DAYS)) == rows(colocated.person_days(landing(*ROWS[:3])))
    assert buckets.Layout.of(tables.manifest(spark, path)) == layout
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("draft_")]
