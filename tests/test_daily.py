"""The daily load: increments, late rows, reruns and stored history."""

import datetime as dt
import re
from decimal import Decimal
from pathlib import Path

import pytest

from shiftledger import schemas
from shiftledger.plans import daily, dimensions, facts
from shiftledger.sources import tables

D = dt.date
H = Decimal
LANDING = (
    "staff_id bigint, staff_name string, manager string, location string, item string, purchase_date date, "
    "total decimal(12,2), actual_hour decimal(5,1)"
)


@pytest.fixture(scope="module")
def landing(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(i, f"Staff {i}", m, place, item, day, H("10.00"), H("2.0")) for i, m, place, item, day in rows], LANDING
        )

    return build


@pytest.fixture(scope="module")
def target(spark):
    days = [(1, "Staff 1", D(2024, 5, d), H("6.0")) for d in range(1, 20)]
    return spark.createDataFrame(days, schemas.TARGET)


def natural(spark, root, rows):
    """The performance fact under natural keys."""
    people = daily.read(spark, root, "dim_practitioner").select("practitioner_dim_id", "practitioner_id", "manager_name")
    places = daily.read(spark, root, "dim_location").select("location_id", "location_name")
    fact = daily.read(spark, root, "fact_performance").join(people, "practitioner_dim_id").join(places, "location_id")
    return rows(fact, "date", "practitioner_id", "manager_name", "location_name", "target_hour", "actual_hour", "total_billing")


BASE = [(i, "Kim", f"P{i}", f"I{i % 2}", D(2024, 5, d)) for i in (1, 2, 3) for d in (1, 2, 3, 6)]
BASE += [(3, "Kim", "P3", "I1", D(2024, m, 1)) for m in (3, 4)]


def test_days_in_order_equal_one_load(spark, tmp_path, landing, target, rows):
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    more = [(4, "Kim", "P9", "I7", D(2024, 5, 7)), (1, "Kim", "P1", "I1", D(2024, 5, 7))]
    daily.run_daily(spark, whole, landing(*BASE, *more), target, D(2024, 5, 7))
    for day in (3, 6, 7):
        seen = [r for r in BASE + more if r[4] <= D(2024, 5, day)]
        daily.run_daily(spark, split, landing(*seen), target, D(2024, 5, day))
    assert natural(spark, split, rows) == natural(spark, whole, rows)
    assert rows(daily.read(spark, split, "fact_appointments")) != []
    for name, col in (("dim_location", "location_name"), ("dim_item", "item_name")):
        assert rows(daily.read(spark, split, name), col) == rows(daily.read(spark, whole, name), col)
        ids = [r[0] for r in daily.read(spark, split, name).collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))


def test_late_rows_change_their_day_once(spark, tmp_path, landing, target, rows):
    late = [(1, "Kim", "P1", "I1", D(2024, 5, 3)), (3, "Kim", "P3", "I1", D(2024, 4, 1)), (5, "Kim", "P5", "I5", D(2024, 5, 1)), (1, "Old", "P1", "I1", D(2024, 5, 3))]
    same = (1, "Kim", "P1", "I1", D(2024, 5, 3))
    root, whole = str(tmp_path / "late"), str(tmp_path / "whole")
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 6))
    before = {k: v for k, v in tables.manifest(spark, f"{root}/fact_performance").parts.items()}
    new = [(2, "Kim", "P2", "I0", D(2024, 5, 8))]
    days = daily.days_of(landing(*late))
    for _ in range(2):  # a repeated run gives the same
        daily.run_daily(spark, root, landing(*BASE, *late, *new), target, D(2024, 5, 8), changed_days=days)
        found = natural(spark, root, rows)
        assert [r for r in found if r[:2] == (D(2024, 5, 3), 1)] == [(D(2024, 5, 3), 1, "Kim", "P1", H("6.0"), H("6.0"), H("30.0"))]
        assert [r for r in found if r[1] == 5] == [(D(2024, 5, 1), 5, "Kim", "P5", H(0), H("2.0"), H("10.0"))]
        after = tables.manifest(spark, f"{root}/fact_performance").parts
        assert {k for k in after if before.get(k) != after[k]} == {"2024-04", "2024-05"}, "March keeps its files"
    daily.run_daily(spark, whole, landing(*BASE, *late[:3], *new, same), target, D(2024, 5, 8))
    assert found == natural(spark, whole, rows)


def test_lookback_restates_its_days(spark, tmp_path, landing, target, rows):
    root, whole = str(tmp_path / "look"), str(tmp_path / "whole")
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 6))
    rest = [*BASE, (2, "Kim", "P2", "I0", D(2024, 5, 6)), (2, "Kim", "P2", "I0", D(2024, 5, 5))]
    daily.run_daily(spark, root, landing(*rest), target, D(2024, 5, 7), lookback_days=2)
    daily.run_daily(spark, whole, landing(*rest), target, D(2024, 5, 7))
    assert natural(spark, root, rows) == natural(spark, whole, rows)
    # A changed day that has lost its rows is empty afterwards.
    daily.run_daily(spark, root, landing(*[r for r in rest if r[4].day != 2]), target, D(2024, 5, 8), changed_days=[D(2024, 5, 2)])
    assert daily.read(spark, root, "fact_performance").where("date = '2024-05-02'").count() == 0


def day_totals(spark, root, rows):
    """The stored day totals, checked against the whole fact."""
    found = rows(daily.read(spark, root, "day_totals"))
    assert found == rows(facts.day_totals(daily.read(spark, root, "fact_performance")))
    return found


def test_day_totals_follow_the_touched_months(spark, tmp_path, landing, target, rows):
    root = str(tmp_path / "totals")
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 6))
    assert day_totals(spark, root, rows) == rows(facts.first_day_totals(landing(*BASE), target))
    before = tables.manifest(spark, f"{root}/day_totals").parts
    late = [(3, "Kim", "P3", "I1", D(2024, 4, 1)), (2, "Kim", "P2", "I0", D(2024, 6, 1))]
    daily.run_daily(spark, root, landing(*BASE, *late), target, D(2024, 6, 1), changed_days=[D(2024, 4, 1)])
    assert day_totals(spark, root, rows) == rows(facts.first_day_totals(landing(*BASE, *late), target))
    after = tables.manifest(spark, f"{root}/day_totals").parts
    assert set(after) == {"2024-03", "2024-04", "2024-05", "2024-06"} and after["2024-03"] == before["2024-03"]
    # A month that has lost all its rows is gone from both.
    rest = [r for r in BASE + late if r[4].month != 3]
    daily.run_daily(spark, root, landing(*rest), target, D(2024, 6, 2), changed_days=[D(2024, 3, 1)])
    assert {r[0].month for r in day_totals(spark, root, rows)} == {4, 5, 6}


def test_day_totals_are_made_good(spark, tmp_path, landing, target, rows):
    root = str(tmp_path / "lost")
    path = {name: f"{root}/{name}" for name in daily.TABLES}
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 6))
    # A run that was lost between the totals and the fact leaves totals of rows that the fact does not hold.
    extra = daily.read(spark, root, "fact_performance").where("date = '2024-04-01'")
    lost = tables.prepare_parts(extra.unionByName(extra), path["fact_performance"], tables.month("date"))
    daily.update_totals(spark, path, lost)
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 7))
    assert day_totals(spark, root, rows) != []
    # A warehouse from before the totals gets them with its next load.
    tables.commit(spark, path["day_totals"], tables.Manifest(99))
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 8))
    assert len(day_totals(spark, root, rows)) == 6


def test_closed_versions_keep_their_files(spark, tmp_path, landing, target, rows):
    root = str(tmp_path / "history")
    path = f"{root}/dim_practitioner"
    for day, manager in ((1, "Kim"), (2, "Lou"), (3, "Lou"), (6, "Max")):
        batch = [(1, manager, "P1", "I1", D(2024, 5, day)), (2, "Kim", "P2", "I1", D(2024, 5, day))]
        daily.run_daily(spark, root, landing(*batch), target, D(2024, 5, day))
    parts = tables.manifest(spark, path).parts
    assert set(parts) == {daily.CURRENT, "closed-20240502", "closed-20240506"}
    assert parts["closed-20240502"] == tables.manifest(spark, path, at=20240502).parts["closed-20240502"]
    found = rows(daily.read(spark, root, "dim_practitioner"), "practitioner_id", "manager_name", "effective_end_date", "is_current")
    assert found == [(1, "Kim", D(2024, 5, 1), False), (1, "Lou", D(2024, 5, 5), False), (1, "Max", None, True), (2, "Kim", None, True)]
    ids = [r.practitioner_dim_id for r in daily.read(spark, root, "dim_practitioner").collect()]
    assert len(set(ids)) == len(ids)


def test_plans(spark, tmp_path, landing):
    rows = landing(*BASE)
    rows.write.parquet(str(tmp_path / "landing"))
    stored = spark.read.schema(rows.schema).parquet(str(tmp_path / "landing"))
    fresh = daily.increment(stored, "purchase_date", D(2024, 5, 3), [D(2024, 5, 1)])
    plan = dimensions.members(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(purchase_date,2024-05-03)" in plan
    people = dimensions.first_practitioners(rows, dimensions.first_locations(rows), "x")
    merged = dimensions.merge_practitioners(people, rows, dimensions.first_locations(rows), "x", D(2024, 5, 9))
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    assert not list(Path(tmp_path).glob("none"))


@pytest.mark.parametrize("pieces", [None, 7])
def test_rows_are_dealt_by_person_and_day_before_they_are_summed(spark, tmp_path, monkeypatch, landing, target, rows, pieces):
    plans, restated = {}, daily.restated

    def seen(spark, path, name, df, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return restated(spark, path, name, df, *rest)

    monkeypatch.setattr(daily, "restated", seen)
    root, plain = str(tmp_path / "dealt"), str(tmp_path / "plain")
    daily.run_daily(spark, root, landing(*BASE), target, D(2024, 5, 6), pieces=pieces)
    plan = plans["fact_performance"]
    below = plan[re.search(r"partial_sum\((UnscaledValue\()?actual_hour", plan).start() :]
    first = next(line for line in below.split("\n") if "Exchange" in line)
    assert "hashpartitioning(staff_id" in first and "REPARTITION_BY" in first
    assert pieces is None or f", {pieces}), REPARTITION_BY_NUM" in first
    daily.run_daily(spark, plain, landing(*BASE), target, D(2024, 5, 6))
    assert natural(spark, root, rows) == natural(spark, plain, rows) != []
