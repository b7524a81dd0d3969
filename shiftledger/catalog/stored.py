"""Stored tables: changes that rewrite only the months they touch, snapshots with retention, and the daily load."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger import schemas
from shiftledger.catalog import targets
from shiftledger.catalog.base import query, same_as
from shiftledger.catalog.warehouse import star
from shiftledger.plans import colocated, daily, kpi, stored
from shiftledger.session import work_dir
from shiftledger.sources import tables, writers
from shiftledger.sources.mapping import Landing


def changed(t: Landing, change: Callable[[str], object]) -> DataFrame:
    """The target table stored by month, changed in place and read back."""
    path = work_dir(t.spark, "targets")
    stored.write_targets(t.target_update(), path)
    change(path)
    return stored.read_targets(t.spark, path)


@same_as("upsert_targets", "stored_upsert_targets")
def stored_upsert_targets(t: Landing) -> DataFrame:
    """Edits and Sundays written into the months they fall into."""
    return changed(t, lambda path: stored.upsert(t.spark, path, targets.edits(t).unionByName(targets.sundays(t))))


@same_as("update_targets", "stored_update_targets")
def stored_update_targets(t: Landing) -> DataFrame:
    change = targets.edits(t).unionByName(targets.sundays(t))
    return changed(t, lambda path: stored.update(t.spark, path, change, ["target_hour", "updated_at"]))


@same_as("delete_targets_keys", "stored_delete_targets_keys")
def stored_delete_targets_keys(t: Landing) -> DataFrame:
    return changed(t, lambda path: stored.delete_keys(t.spark, path, targets.saturdays(t)))


@same_as("delete_targets_range", "stored_delete_targets_range")
def stored_delete_targets_range(t: Landing) -> DataFrame:
    """One year's months are rewritten, the others keep their files."""
    chosen = targets.chosen(t)
    return changed(t, lambda path: stored.delete_range(t.spark, path, chosen, p.YEAR_START, p.YEAR_END))


@query("stored_snapshots", "SELECT * FROM practitioner", "practitioner")
def stored_snapshots(t: Landing) -> DataFrame:
    """Three snapshots of the practitioners, of which one is retired; a half-written one stays invisible."""
    path = work_dir(t.spark, "practitioner")
    people = t.practitioner()
    for snapshot in (1, 2, 3):
        writers.write_snapshot(people, path, snapshot, keep=2)
    tables.write_parts(people.limit(1), path)  # lost before its commit
    return writers.read_snapshot(t.spark, path, schemas.PRACTITIONER)


_NATURAL = "date, practitioner_id, manager_name, location_name, target_hour, actual_hour, total_billing"
_NATURAL_SQL = """
    SELECT f.date, d.practitioner_id, d.manager_name, l.location_name, f.target_hour, f.actual_hour, f.total_billing
    FROM fact_performance f JOIN dim_practitioner d ON f.practitioner_dim_id = d.practitioner_dim_id
    JOIN dim_location l ON f.location_id = l.location_id"""


def natural_performance(t: Landing, warehouse: str) -> DataFrame:
    """The stored performance fact under natural keys."""
    people = daily.read(t.spark, warehouse, "dim_practitioner")
    places = daily.read(t.spark, warehouse, "dim_location").select("location_id", "location_name")
    people = people.select("practitioner_dim_id", "practitioner_id", "manager_name")
    fact = daily.read(t.spark, warehouse, "fact_performance")
    return fact.join(people, "practitioner_dim_id").join(places, "location_id").select(*_NATURAL.split(", "))


def two_loads(t: Landing) -> str:
    """The warehouse folder after a first load and one of the rows since; the second reads the increment only."""
    warehouse = work_dir(t.spark, "warehouse")
    for until, batch in ((p.SPLIT_DATE, p.SPLIT_DATE), (None, p.SPLIT_DATE + dt.timedelta(days=365))):
        daily.run_daily(t.spark, warehouse, t.input(until=until), t.target(), batch, pieces=t.pieces())
    return warehouse


@query("daily_load", _NATURAL_SQL, "fact_performance dim_practitioner dim_location")
def daily_load(t: Landing) -> DataFrame:
    """The performance fact after a first load and one of the rows since."""
    return natural_performance(t, two_loads(t))


@same_as("daily_load", "daily_load_late_rows")
def daily_load_late_rows(t: Landing) -> DataFrame:
    """A fifth of a month's rows land a batch late; their days are computed again and replace their own parts."""
    warehouse = work_dir(t.spark, "warehouse")
    first = t.input(until=p.SPLIT_DATE)
    late = F.col("purchase_date").between(F.lit(p.LATE_START), F.lit(p.LATE_END)) & (F.col("invoice_no") % 5 == 0)
    daily.run_daily(t.spark, warehouse, first.where(~late), t.target(), p.SPLIT_DATE, pieces=t.pieces())
    days = daily.days_of(first.where(late))
    batch = p.SPLIT_DATE + dt.timedelta(days=365)
    daily.run_daily(t.spark, warehouse, t.input(), t.target(), batch, changed_days=days, pieces=t.pieces())
    return natural_performance(t, warehouse)


@same_as("kpi_by_period", "stored_kpi_by_period")
def stored_kpi_by_period(t: Landing) -> DataFrame:
    """Figures of all periods from the day totals that two daily loads keep; the fact is not read."""
    return kpi.by_period(daily.read(t.spark, two_loads(t), "day_totals"))


@same_as("kpi_by_calendar", "stored_kpi_by_calendar")
def stored_kpi_by_calendar(t: Landing) -> DataFrame:
    return kpi.by_calendar(daily.read(t.spark, two_loads(t), "day_totals"), "year", "quarter")


def days_and_targets(t: Landing) -> tuple[str, str]:
    """Daily sums and targets in the same buckets by person and day."""
    days, targets_path = work_dir(t.spark, "person_days"), work_dir(t.spark, "day_targets")
    colocated.write_person_days(t.per_day(), days, t.buckets())
    colocated.write_day_targets(t.target(), targets_path, t.buckets())
    return days, targets_path


@same_as("left_join_target_daily", "bucketed_join_target_daily")
def bucketed_join_target_daily(t: Landing) -> DataFrame:
    """The stored sums and targets are joined bucket by bucket, without a shuffle."""
    return colocated.daily_with_target(t.spark, *days_and_targets(t))


@same_as("left_join_target_daily", "bucketed_late_rows")
def bucketed_late_rows(t: Landing) -> DataFrame:
    """A month's days are summed without a fifth of their rows first, and then restated in the stored buckets."""
    rows = t.input(items=False).repartition(t.pieces(), "staff_id", "purchase_date")
    late = F.col("purchase_date").between(F.lit(p.LATE_START), F.lit(p.LATE_END)) & (F.col("invoice_no") % 5 == 0)
    days, targets_path = work_dir(t.spark, "person_days"), work_dir(t.spark, "day_targets")
    colocated.write_person_days(rows.where(~late), days, t.buckets())
    colocated.write_day_targets(t.target(), targets_path, t.buckets())
    colocated.restate_person_days(rows, days, daily.days_of(rows.where(late)))
    return colocated.daily_with_target(t.spark, days, targets_path)


@same_as("fact_performance", "bucketed_fact_performance")
def bucketed_fact_performance(t: Landing) -> DataFrame:
    dims = star(t)
    return colocated.fact_performance(t.spark, *days_and_targets(t), dims.people, dims.places)


@same_as("left_merge_weekly", "bucketed_merge_weekly")
def bucketed_merge_weekly(t: Landing) -> DataFrame:
    """Weekly sums and weekly targets in the same buckets by week and person."""
    weeks, targets_path = work_dir(t.spark, "weeks"), work_dir(t.spark, "weekly_targets")
    colocated.write_weeks(t.performance(types=False, names=False), weeks, t.buckets())
    colocated.write_weekly_targets(t.weekly_target(), targets_path, t.buckets())
    return colocated.weekly_with_target(t.spark, weeks, targets_path, "target_income", "target_hour")
