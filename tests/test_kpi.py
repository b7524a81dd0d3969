"""Dashboards on a small sheet."""

import datetime as dt
from decimal import Decimal

import pytest

from shiftledger import schemas
from shiftledger.operators import aggregates, ordering, reshape
from shiftledger.plans import kpi

D = dt.date
H = Decimal


@pytest.fixture(scope="module")
def perf(spark):
    rows = [
        # ISO week 1 of 2024 and of 2025 merge.
        (D(2024, 1, 1), 1, "Ann", "yoga", H("4.0"), H("100.00")),
        (D(2024, 12, 30), 1, "Ann", "massage", H("2.0"), H("60.00")),
        (D(2024, 1, 8), 1, "Ann", "yoga", H("5.0"), H("90.00")),
        (D(2024, 1, 9), 2, "Bo", "yoga", H("3.0"), H("30.00")),
    ]
    return spark.createDataFrame(rows, schemas.PERFORMANCE)


@pytest.fixture(scope="module")
def wanted(spark):
    rows = [
        (1, "yoga", 1, H("200.00"), H("8.0")),
        (1, "massage", 1, H("50.00"), H("4.0")),
        (1, "yoga", 2, H("100.00"), H("0.0")),
    ]
    return spark.createDataFrame(rows, schemas.WEEKLY_TARGET)


def test_weeks_merge_over_years(perf, rows):
    weekly = aggregates.weekly_performance(perf, "practitioner_id")
    assert rows(weekly) == [(1, 1, H("6.0"), H("160.00")), (2, 1, H("5.0"), H("90.00")), (2, 2, H("3.0"), H("30.00"))]


def test_weekly_ratio_repeats_per_target_row(perf, wanted, rows):
    found = rows(kpi.weekly_ratio(perf, wanted), "week", "practitioner_id", "target_hour", "performance_ratio")
    assert found == [(1, 1, H("4.0"), 1.5), (1, 1, H("8.0"), 0.75), (2, 1, H("0.0"), None), (2, 2, None, None)]


def test_totals_equal_the_sum_of_the_repeated_rows(perf, wanted, rows):
    master = kpi.master_weekly(perf, wanted)
    by_hand = master.groupBy("practitioner_id").sum("total_hours", "total_income", "target_hour", "target_income")
    totals = kpi.practitioner_totals(perf, wanted)
    cols = ("total_hours", "total_income", "target_hours", "target_income")
    assert rows(totals, "practitioner_id", *cols) == rows(by_hand)
    assert rows(totals, "practitioner_id", "total_hours") == [(1, H("17.0")), (2, H("3.0"))]


def test_dedup_totals_count_each_week_once(perf, wanted, rows):
    found = rows(kpi.master_totals_dedup(perf, wanted), "practitioner_id", "total_hours", "target_hours")
    assert found == [(1, H("11.0"), H("12.0")), (2, H("3.0"), None)]


def test_totals_by_name(spark, perf, rows):
    wanted = spark.createDataFrame([("Ann", 1, H("10.00"), H("3.0"))], "practitioner_name string, week int, target_income decimal(12,2), target_hour decimal(12,1)")
    found = kpi.master_totals(perf, wanted, "practitioner_name")
    assert rows(found, "practitioner_name", "total_hours", "ratio_performance") == [
        ("Ann", H("11.0"), 11.0 / 3.0),
        ("Bo", H("3.0"), None),
    ]


def test_own_rows_against_targets_of_any_type(perf, wanted):
    mine = kpi.practitioner_weekly_type(perf, wanted, "secondary", 1)
    assert mine.count() == 2 * 2 + 1
    assert kpi.practitioner_weekly_type(perf, wanted, "guest").count() == 0
    profile = kpi.practitioner_null_profile(perf, wanted, "master").first()
    assert profile == aggregates.null_profile(kpi.practitioner_weekly_type(perf, wanted, "master")).first()
    assert (profile.week, profile.target_hour, profile.performance_ratio) == (0, 1, 2)


def test_long_form(perf, wanted, rows):
    wide = kpi.practitioner_by_type(perf, wanted, "secondary", 2)
    assert rows(reshape.hours_long(wide)) == [(2, "yoga", "target_hour", None), (2, "yoga", "total_hours", H("3.0"))]
    assert reshape.income_long(wide).columns == ["week", "appt_type", "income_type", "income"]


def test_week_head(perf, wanted):
    found = kpi.practitioner_week_head(perf, wanted, 1, n=1).collect()
    assert [(r.week, r.appt_type, r.performance_ratio) for r in found] == [(1, "massage", 1.5)]


def test_head_is_in_order(perf):
    weekly = aggregates.weekly_performance(perf, "practitioner_id")
    assert [r.week for r in ordering.head(weekly, 2, "week", "practitioner_id").collect()] == [1, 2]


def test_calendar_kpis_keep_years_apart(spark, rows):
    fact = spark.createDataFrame(
        [(D(2024, 1, 1), 1, 1, H("6"), H("3"), H("0")), (D(2024, 12, 30), 1, 1, H("6"), H("6"), H("0"))],
        schemas.FACT_PERFORMANCE,
    )
    weeks = kpi.by_period(fact, ("week",))
    assert rows(weeks, "period_start", "performance_ratio") == [(D(2024, 1, 1), 0.5), (D(2024, 12, 30), 1.0)]
    assert kpi.by_period(fact, ("year",)).first().actual_hour == H("9.0")


def test_calendar_attributes_without_a_date_dimension(spark, rows):
    fact = spark.createDataFrame(
        [(D(2024, 1, 1), 1, 1, H("6"), H("3"), H("0")), (D(2024, 12, 30), 1, 1, H("0"), H("2"), H("0")), (None, 1, 1, H("1"), H("1"), H("0"))],
        schemas.FACT_PERFORMANCE,
    )
    found = kpi.by_calendar(fact, "year", "quarter")
    assert rows(found) == [(2024, 1, H("3.0"), H("6.0"), 0.5), (2024, 4, H("2.0"), H("0.0"), None)]
    assert rows(kpi.by_calendar(fact, "week_of_year"), "week_of_year", "actual_hour") == [(1, H("5.0"))]


def test_rollup_levels(spark, rows):
    fact = spark.createDataFrame(
        [(D(2024, 1, 1), 1, 1, H("6"), H("3"), H("0")), (D(2024, 1, 2), 2, 1, H("4"), H("4"), H("0"))],
        schemas.FACT_PERFORMANCE,
    )
    people = spark.createDataFrame([(1, "Kim", "Ann"), (2, "Lou", "Bo")], "practitioner_dim_id bigint, manager_name string, practitioner_name string")
    places = spark.createDataFrame([(1, "North", None)], schemas.DIM_LOCATION)
    found = kpi.by_location_manager_staff(fact, people, places)
    assert found.count() == 1 + 1 + 2 + 2
    assert found.where("location_name is null").first().actual_hour == H("7.0")
    unnamed = spark.createDataFrame([(1, None, "Ann"), (2, None, "Bo")], people.schema)
    levels = kpi.by_location_manager_staff(fact, unnamed, places)
    assert sorted(r.level for r in levels.where("manager_name is null").collect()) == [0, 1, 2, 3, 3]
    assert found.where("manager_name = 'Kim' and practitioner_name is null").first().performance_ratio == 0.5


def test_summaries_by_calendar_period(spark, rows):
    targets = spark.createDataFrame(
        [(1, "Ann", D(2024, 7, 29), H("6"), None), (1, "Ann", D(2024, 8, 4), H("4"), None), (1, "Ann", D(2024, 10, 1), H("1"), None)],
        schemas.TARGET_UPDATE,
    )
    assert rows(aggregates.target_summary(targets, "week")) == [(D(2024, 7, 29), H("10.0")), (D(2024, 9, 30), H("1.0"))]
    assert rows(aggregates.target_summary(targets, "quarter")) == [(D(2024, 7, 1), H("10.0")), (D(2024, 10, 1), H("1.0"))]
