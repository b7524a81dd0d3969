"""Readers, writers and the daily load."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from shiftledger import schemas
from shiftledger.plans import facts
from shiftledger.plans.daily import TABLES, read, run_daily
from shiftledger.sources import readers, writers

D = dt.date
H = Decimal

INPUT_CSV = (
    "﻿Location,Purchase Date,Client,Item,Staff ID,Staff name,Manager,Invoice #,Total, Actual hour \n"
    'North,"July 29, 2024",,,1,Ann Lee,Kim,,,6\n'
    'South,"August 1, 2024",,yoga,2,Bo Day,Lou,17,80.50,3.5\n'
)


def test_input_csv_with_mark_blanks_and_other_order(spark, tmp_path):
    path = tmp_path / "input.csv"
    path.write_text(INPUT_CSV, encoding="utf-8")
    frame = readers.read_input(spark, str(path), format="csv")
    assert frame.schema.simpleString() == schemas.INPUT.simpleString()
    first, second = frame.orderBy("staff_id").collect()
    assert (first.location, first.purchase_date, first.item, first.total) == ("North", D(2024, 7, 29), None, None)
    assert (second.invoice_no, second.total, second.actual_hour) == ("17", H("80.50"), H("3.5"))


def test_target_csv_in_the_short_format(spark, tmp_path):
    path = tmp_path / "target.csv"
    path.write_text("﻿Staff ID,Staff name,appt_date,Target_hour\n1,Ann Lee,29-Jul-24,6\n", encoding="utf-8")
    row = readers.read_target(spark, str(path), format="csv", date_pattern="d-MMM-yy").first()
    assert tuple(row) == (1, "Ann Lee", D(2024, 7, 29), H("6.0"))


def test_strict_reading_raises_and_tolerant_reading_gives_null(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('Staff ID,appt_date,Target_hour\nx,"July 29, 2024",6\n1,soon,\n', encoding="utf-8")
    with pytest.raises(PySparkException):
        readers.read_target(spark, str(path), format="csv").collect()
    found = readers.read_target(spark, str(path), format="csv", strict=False).collect()
    assert {(r.staff_id, r.appt_date, r.staff_name) for r in found} == {(None, D(2024, 7, 29), None), (1, None, None)}


def test_sheets(spark, tmp_path):
    path = tmp_path / "perf.csv"
    path.write_text("Appt. Date,Practitioner ID ,Appt. Type,Total Hours,Total Income\n8/1/2024,5,yoga,2.5,99.90\n")
    row = readers.read_performance(spark, str(path), format="csv").first()
    assert (row.appt_date, row.practitioner_id, row.appt_type) == (D(2024, 8, 1), 5, "yoga")
    with pytest.raises(ValueError):
        readers.read_performance(spark, str(path), format="xlsx")


def test_planning_tables(spark, tmp_path):
    text = {
        "people": "Practitioner ID,Practitioner Name,Clinic Location,Manager Name\n1,Ann,North,Kim\n",
        "weekly": "Practitioner ID,Appt. Type,Week,Target Income,Target Hour\n1,yoga,5,100,6\n",
        "holidays": "holiday_date\n2024-07-01\n",
    }
    for name, content in text.items():
        (tmp_path / f"{name}.csv").write_text(content)
    people = readers.read_practitioners(spark, str(tmp_path / "people.csv"), format="csv")
    weekly = readers.read_weekly_targets(spark, str(tmp_path / "weekly.csv"), format="csv")
    holidays = readers.read_holidays(spark, str(tmp_path / "holidays.csv"), format="csv")
    assert tuple(people.first()) == (1, "Ann", "North", "Kim")
    assert tuple(weekly.first()) == (1, "yoga", 5, H("100.00"), H("6.0"))
    assert tuple(holidays.first()) == (D(2024, 7, 1),)
    people.write.parquet(str(tmp_path / "people"))
    assert readers.read_practitioners(spark, str(tmp_path / "people")).collect() == people.collect()


def test_snapshots(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    assert writers.read_snapshot(spark, path, schemas.DIM_LOCATION).count() == 0
    for tag, name in ((1, "North"), (2, "South"), (2, "South"), (5, "West")):
        writers.write_snapshot(spark.createDataFrame([(tag, name, None)], schemas.DIM_LOCATION), path, tag)
    assert rows(writers.read_snapshot(spark, path, schemas.DIM_LOCATION)) == [(5, "West", None)]
    assert rows(writers.read_snapshot(spark, path, schemas.DIM_LOCATION, before=5)) == [(2, "South", None)]
    assert writers.read_snapshot(spark, path, schemas.DIM_LOCATION, before=1).count() == 0


def test_export_does_not_overwrite(spark, tmp_path, rows):
    targets = spark.createDataFrame(
        [(1, "Ann", D(2024, 8, 1), H("6.0"), dt.datetime(2024, 1, 1, 10, 30))], schemas.TARGET_UPDATE
    )
    path = str(tmp_path / "export")
    writers.export_targets(targets, path)
    assert rows(readers.read_target_updates(spark, path, format="csv")) == rows(targets)
    with pytest.raises(PySparkException):
        writers.export_targets(targets, path)
    writers.export_targets(targets, str(tmp_path / "parquet"), format="parquet")
    assert rows(readers.read_target_updates(spark, str(tmp_path / "parquet"))) == rows(targets)


@pytest.fixture(scope="module")
def landing(spark):
    days = [D(2024, 7, 30), D(2024, 7, 31), D(2024, 8, 1), D(2024, 8, 2)]
    rows = []
    for n, day in enumerate(days):
        for staff in (1, 2, 3):
            manager = "Lou" if staff == 3 and n >= 2 else "Kim"
            place, item = ("South", "yoga") if n >= 2 and staff == 2 else ("North", "massage")
            rows.append((place, day, item, staff, f"Staff {staff}", manager, H("10.25") * staff, H("1.5") + n))
    return spark.createDataFrame(
        rows,
        "location string, purchase_date date, item string, staff_id bigint, staff_name string, manager string, "
        "total decimal(12,2), actual_hour decimal(5,1)",
    )


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "Staff 1", D(2024, 8, 1), H("6.0"))], schemas.TARGET)


def tables(spark, root):
    dims = {n: read(spark, root, n) for n in TABLES if n.startswith("dim_")}
    loaded = {n: read(spark, root, n) for n in TABLES if n.startswith("fact_")}
    return dims, loaded


def test_two_days_of_loads(spark, tmp_path, landing, target, rows):
    root = str(tmp_path / "warehouse")
    old = landing.where("purchase_date <= date'2024-07-31'")
    run_daily(spark, root, old, target, D(2024, 7, 31))
    dims, loaded = tables(spark, root)
    assert dims["dim_location"].count() == 1 and loaded["fact_performance"].count() == 6

    run_daily(spark, root, landing, target, D(2024, 8, 2))
    dims, loaded = tables(spark, root)
    assert rows(dims["dim_location"], "location_id", "location_name") == [(1, "North"), (2, "South")]
    assert rows(dims["dim_item"], "item_id", "item_name") == [(1, "massage"), (2, "yoga")]
    people = dims["dim_practitioner"]
    assert rows(people.where("is_current"), "practitioner_id", "manager_name") == [(1, "Kim"), (2, "Kim"), (3, "Lou")]
    assert people.count() == 4
    # Old facts keep the old version of staff member 3, new facts have the new one.
    assert loaded["fact_performance"].count() == 12 and loaded["fact_appointments"].count() == 12
    joined = loaded["fact_performance"].join(people, "practitioner_dim_id")
    found = {(r.date, r.manager_name) for r in joined.where("practitioner_id = 3").collect()}
    assert (D(2024, 7, 30), "Kim") in found and (D(2024, 8, 2), "Lou") in found
    assert loaded["fact_performance"].where("target_hour = 6.0").count() == 1

    before = {name: rows(df) for name, df in {**dims, **loaded}.items()}
    run_daily(spark, root, landing, target, D(2024, 8, 2))
    dims, loaded = tables(spark, root)
    assert {name: rows(df) for name, df in {**dims, **loaded}.items()} == before


def test_a_run_lost_between_the_facts_is_made_good(spark, tmp_path, landing, target, rows, monkeypatch):
    root, whole = str(tmp_path / "lost"), str(tmp_path / "whole")
    run_daily(spark, whole, landing, target, D(2024, 8, 2))

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(facts, "fact_performance", lost)
        with pytest.raises(RuntimeError):
            run_daily(spark, root, landing, target, D(2024, 8, 2))
    assert tables(spark, root)[1]["fact_performance"].count() == 0
    run_daily(spark, root, landing, target, D(2024, 8, 2))
    for name, df in tables(spark, root)[1].items():
        assert rows(df) == rows(tables(spark, whole)[1][name])
