"""Target planning and table changes on small plans."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shiftledger import schemas
from shiftledger.operators import aggregates, changes, filters, joins, reshape
from shiftledger.plans import planning
from shiftledger.sources.mapping import timestamp

D = dt.date
H = Decimal
T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 9, 1, 8)
MONDAY = D(2024, 7, 29)


def day(n):
    return MONDAY + dt.timedelta(n)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", "North", "Kim"), (2, "Bo", "South", "Kim"), (3, "Cy", "South", "Lou")]
    return spark.createDataFrame(rows, schemas.PRACTITIONER)


@pytest.fixture(scope="module")
def targets(spark):
    def build(*rows):
        names = {1: "Ann", 2: "Bo", 3: "Cy"}
        return spark.createDataFrame(
            [(i, names[i], d, H(str(h)), T0) for i, d, h in rows], schemas.TARGET_UPDATE
        )

    return build


@pytest.fixture(scope="module")
def holidays(spark):
    return spark.createDataFrame([(day(0),), (day(0),), (D(2024, 12, 25),)], schemas.HOLIDAYS)


def test_weekday_plan_status(people, targets, holidays, rows):
    plan = {"Monday": 6.0, "Tuesday": 5.5}
    stored = targets((1, day(0), 4), (2, day(1), 4))
    planned = planning.set_weekday_plan(people, stored, holidays, day(0), day(6), plan)
    assert rows(planned, "practitioner_id", "target_date", "target_hour", "status") == [
        (1, day(0), H("6.0"), "holiday"),
        (1, day(1), H("5.5"), "inserted"),
        (2, day(0), H("6.0"), "holiday"),
        (2, day(1), H("5.5"), "conflict"),
        (3, day(0), H("6.0"), "holiday"),
        (3, day(1), H("5.5"), "inserted"),
    ]
    assert rows(planning.status_counts(planned)) == [("conflict", 1), ("holiday", 3), ("inserted", 2)]
    added = planning.inserted(planned, timestamp(NOW))
    assert added.schema.names == schemas.TARGET_UPDATE.names
    assert {r.updated_at for r in added.collect()} == {NOW}


def test_statuses_cover_all_planned_days_once(people, targets, holidays):
    plan = {name: 4.0 for name in ("Monday", "Wednesday", "Sunday")}
    planned = planning.set_weekday_plan(people, targets((3, day(2), 5)), holidays, day(0), day(20), plan)
    assert planned.count() == 3 * 9
    assert planned.groupBy("practitioner_id", "target_date").count().where("count > 1").count() == 0


def test_reversed_range_plans_nothing(people, targets, holidays):
    assert planning.set_weekday_plan(people, targets(), holidays, day(3), day(0), {"Monday": 6.0}).count() == 0


def test_constant_goes_to_people_with_a_target_in_the_range(people, targets, rows):
    stored = targets((1, day(0), 4), (2, day(9), 4))
    after = planning.set_constant(stored, people, day(0), day(1), 7.5, timestamp(NOW))
    assert rows(after, "practitioner_id", "target_date", "target_hour") == [
        (1, day(0), H("7.5")),
        (1, day(1), H("7.5")),
        (2, day(9), H("4.0")),
    ]
    only_south = planning.set_constant(stored, people, day(0), day(9), 7.5, timestamp(NOW), location="South")
    assert only_south.where("practitioner_id = 1").count() == 1
    assert only_south.where("practitioner_id = 2").count() == 10


def test_clone_latest_week(people, targets, holidays, rows):
    # The newest target lies in the week of day 7, so day 1 is not copied.
    stored = targets((1, day(1), 3), (1, day(7), 6), (2, day(8), 5), (2, day(14) - dt.timedelta(1), 4))
    cloned = planning.clone_latest_week(people, stored, holidays, day(14), day(15))
    assert rows(cloned, "practitioner_id", "target_date", "target_hour", "status") == [
        (1, day(14), H("6.0"), "inserted"),
        (2, day(15), H("5.0"), "inserted"),
    ]
    over = planning.clone_latest_week(people, stored, holidays, day(0), day(1))
    assert rows(over, "practitioner_id", "target_date", "target_hour", "status") == [
        (1, day(0), H("6.0"), "holiday"),
        (1, day(1), None, "conflict"),
        (2, day(0), None, "holiday"),
        (2, day(1), H("5.0"), "inserted"),
        (3, day(0), None, "holiday"),
    ]


def test_clone_aligned_on_the_same_weekday_of_last_month(people, targets, rows):
    # Monday 5 August 2024 is the first Monday; the first Monday of July is the 1st.
    start, end = D(2024, 8, 5), D(2024, 8, 9)
    stored = targets((1, D(2024, 7, 1), 6), (1, D(2024, 7, 5), 4), (1, D(2024, 7, 6), 7), (2, D(2024, 8, 7), 5))
    cloned = planning.clone_aligned(people, stored, start, end, "last_month")
    assert rows(cloned, "practitioner_id", "target_date", "target_hour", "status") == [
        (1, D(2024, 8, 5), H("6.0"), "cloned"),
        (1, D(2024, 8, 9), H("4.0"), "cloned"),
        (2, None, None, "conflict"),
        (3, None, None, "no_source"),
    ]
    after = planning.apply_clones(stored, cloned, timestamp(NOW))
    assert after.count() == 6


def test_clone_aligned_week_and_year(people, targets, rows):
    stored = targets((1, D(2024, 7, 29), 6), (2, D(2023, 8, 7), 5))
    week = planning.clone_aligned(people, stored, D(2024, 8, 5), D(2024, 8, 9), "last_week")
    assert (1, D(2024, 8, 5), H("6.0")) in rows(week, "practitioner_id", "target_date", "target_hour")
    year = planning.clone_aligned(people, stored, D(2024, 8, 5), D(2024, 8, 9), "last_year")
    assert (2, D(2024, 8, 5), H("5.0")) in rows(year, "practitioner_id", "target_date", "target_hour")


def test_clone_from_a_month_without_the_fifth_weekday(people, targets):
    # Monday 29 April 2024 is a fifth Monday; March 2024 has four.
    cloned = planning.clone_aligned(people, targets((1, D(2024, 3, 25), 6)), D(2024, 4, 29), D(2024, 4, 30), "last_month")
    assert {r.status for r in cloned.collect()} == {"no_source"}
    with pytest.raises(ValueError):
        planning.clone_aligned(people, targets(), MONDAY, MONDAY, "last_decade")


def test_load_period_and_clone_over_range(people, targets, rows):
    stored = targets((1, D(2024, 6, 30), 3), (1, D(2024, 7, 1), 4), (1, D(2024, 7, 31), 5), (3, D(2024, 7, 2), 6))
    month = planning.load_period(stored, people, "month", D(2024, 8, 15))
    assert rows(month, "practitioner_id", "target_hour") == [(1, H("4.0")), (1, H("5.0")), (3, H("6.0"))]
    kim = planning.load_period(stored, people, "quarter", D(2024, 8, 15), manager="Kim")
    assert rows(kim, "target_date") == [(D(2024, 6, 30),)]
    early = planning.load_period(stored, people, "month", D(2024, 8, 15), max_date=D(2024, 7, 1))
    assert early.count() == 1
    after = planning.clone_over_range(stored, month, D(2024, 7, 31), D(2024, 8, 1), timestamp(NOW))
    assert rows(after.where("target_date >= date'2024-07-31'"), "practitioner_id", "target_date", "target_hour") == [
        (1, D(2024, 7, 31), H("5.0")),
        (1, D(2024, 8, 1), H("5.0")),
        (3, D(2024, 7, 31), H("6.0")),
        (3, D(2024, 8, 1), H("6.0")),
    ]


def test_consolidated_view_is_sorted_and_takes_the_current_name(people, targets):
    stored = targets((2, day(1), 4), (1, day(2), 5), (1, day(0), 6)).withColumn("practitioner_name", F.lit("old"))
    found = planning.consolidated(stored, people, day(0), day(5)).collect()
    assert [(r.practitioner_name, r.target_date) for r in found] == [("Ann", day(0)), ("Ann", day(2)), ("Bo", day(1))]


def test_edits(people, targets, rows):
    stored = targets((1, day(0), 4), (1, day(1), 5))
    edits = targets((1, day(0), 4), (1, day(1), 6), (2, day(0), 9))
    diff = planning.edit_changes(stored, edits)
    assert rows(diff) == [(1, day(1), H("5.0"), H("6.0"))]
    all_days = planning.edit_all(stored, people, day(1), day(1), 3.0, timestamp(NOW))
    assert rows(all_days, "target_date", "target_hour", "updated_at") == [
        (day(0), H("4.0"), T0),
        (day(1), H("3.0"), NOW),
    ]


def test_upsert_is_idempotent_and_delete_undoes_it(targets, rows):
    stored = targets((1, day(0), 4))
    change = targets((1, day(0), 6), (2, day(0), 5))
    once = changes.upsert(stored, change)
    assert rows(once, "practitioner_id", "target_hour") == [(1, H("6.0")), (2, H("5.0"))]
    assert rows(changes.upsert(once, change)) == rows(once)
    fresh = targets((3, day(0), 5), (3, day(1), 5))
    assert rows(changes.delete_keys(changes.upsert(stored, fresh), fresh)) == rows(stored)


def test_last_change_of_a_log_wins(spark, targets, rows):
    log = targets((1, day(0), 4), (1, day(0), 5), (1, day(0), 6)).withColumn(
        "updated_at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(10 - target_hour as int))")
    )
    assert rows(changes.upsert_log(targets((1, day(0), 1)), log), "target_hour") == [(H("4.0"),)]


def test_update_ignores_unknown_keys(targets, rows):
    stored = targets((1, day(0), 4), (2, day(0), 4))
    after = changes.update(stored, targets((1, day(0), 6), (3, day(0), 6)), ["target_hour"])
    assert rows(after, "practitioner_id", "target_hour") == [(1, H("6.0")), (2, H("4.0"))]


def test_delete_range(people, targets, rows):
    stored = targets((1, day(0), 4), (1, day(5), 4), (2, day(0), 4))
    left = changes.delete_range(stored, people.where("practitioner_id = 1"), day(0), day(2))
    assert rows(left, "practitioner_id", "target_date") == [(1, day(5)), (2, day(0))]


def test_week_matrix_keeps_people_without_targets(people, targets):
    found = {r.practitioner_id: r for r in reshape.week_matrix(people, targets((1, day(0), 6), (2, day(6), 4))).collect()}
    assert (found[1].monday, found[1].sunday, found[2].sunday, found[3].monday) == (H("6.0"), None, H("4.0"), None)


def test_group_filters(people, spark):
    assert filters.pick_group(people, "South", "Lou").count() == 2
    assert filters.pick_group(people, "All", "Lou").count() == 1
    assert filters.pick_group(people, None, "All").count() == 3
    assert filters.cascade(people, ["South"], ["Kim", "Lou"], [2, 3]).count() == 2
    many = spark.createDataFrame([(3,)], "id bigint")
    assert filters.cascade(people, practitioners=many).count() == 1


def test_row_security(people):
    assert filters.row_security(people, "master").count() == 3
    assert filters.row_security(people, "secondary", 2).count() == 1
    assert filters.row_security(people, "secondary").count() == 0
    assert filters.row_security(people, "guest", 2).count() == 0


def test_counts_include_people_without_targets(people, targets, rows):
    counts = aggregates.count_targets(people, targets((1, day(0), 4), (1, day(1), 4)))
    assert rows(counts, "practitioner_id", "existing_count") == [(1, 2), (2, 0), (3, 0)]


def test_person_days_need_no_shuffle_and_no_cross_join(people):
    plan = joins.person_days(people, day(0), day(30))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_weekly_update_statuses(spark, rows):
    stored = spark.createDataFrame([(1, "yoga", 5, H("100"), H("6")), (1, "yoga", 6, H("100"), H("6"))], schemas.WEEKLY_TARGET)
    change = spark.createDataFrame([(1, "yoga", 5, H("200"), H("7")), (2, "yoga", 5, H("1"), H("1"))], schemas.WEEKLY_TARGET)
    after = planning.update_weekly_targets(stored, change)
    assert rows(after, "practitioner_id", "week", "target_hour", "status") == [
        (1, 5, H("7.0"), "updated"),
        (1, 6, H("6.0"), "kept"),
        (2, 5, H("1.0"), "rejected"),
    ]


def test_registered_plans_have_no_cross_join_and_push_the_mark_down(spark):
    from pathlib import Path

    from shiftledger.catalog import all_queries

    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).is_dir():
        pytest.skip("no test tables")
    for key in ("targets_set_weekday_plan", "targets_clone_latest_week", "fact_performance", "filter_high_watermark"):
        plan = all_queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan, key
        if key == "filter_high_watermark":
            scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_extendedprice" in line)
            assert "DataFilters" in scan and "Subquery" in scan
