"""Sums and targets stored side by side, in buckets of the keys by which the dashboards and facts join them.

Rows are summed per person, day and location and stored by month; targets lie in the same buckets by person and day, so
the daily join and the performance fact shuffle neither side. Weekly sums and weekly targets lie in buckets by week and
person. Days that change are restated: their months are written anew, all others keep their files.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import schemas
from shiftledger.operators import aggregates, joins
from shiftledger.plans import facts
from shiftledger.sources import buckets, tables


def person_days(rows: DataFrame) -> DataFrame:
    """Landing rows summed per person, day and location, under landing names."""
    daily = aggregates.daily_actuals(rows)
    return daily.withColumnsRenamed({"total_actual_hour": "actual_hour", "total_billing": "total"}).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.PERSON_DAYS]
    )


def write_person_days(rows: DataFrame, path: str, n: int | None = None) -> tables.Manifest:
    """The sums of all landing rows as a new version."""
    return buckets.write_table(person_days(rows), path, ("staff_id", "purchase_date"), n, tables.month("purchase_date"))


def restate_person_days(rows: DataFrame, path: str, days: Sequence[dt.date]) -> tables.Manifest | None:
    """Sum some days of the landing rows again and put them in the place of the stored ones."""
    changed = person_days(rows.where(F.col("purchase_date").isin(list(days))))
    return buckets.restate_days(changed, path, schemas.PERSON_DAYS, "purchase_date", days)


def write_day_targets(target: DataFrame, path: str, n: int | None = None) -> tables.Manifest:
    """The daily targets as a new version."""
    rows = target.select(*schemas.TARGET.names)
    return buckets.write_table(rows, path, ("staff_id", "appt_date"), n, tables.month("appt_date"))


def restate_day_targets(target: DataFrame, path: str, days: Sequence[dt.date]) -> tables.Manifest | None:
    changed = target.where(F.col("appt_date").isin(list(days)))
    return buckets.restate_days(changed, path, schemas.TARGET, "appt_date", days)


def write_weeks(perf: DataFrame, path: str, n: int | None = None) -> tables.Manifest:
    """Weekly sums per person as a new version."""
    weeks = aggregates.weekly_performance(perf, "practitioner_id")
    cast = weeks.select(*[F.col(f.name).cast(f.dataType) for f in schemas.WEEKS])
    return buckets.write_table(cast, path, ("week", "practitioner_id"), n)


def write_weekly_targets(weekly_target: DataFrame, path: str, n: int | None = None) -> tables.Manifest:
    rows = weekly_target.select(*schemas.WEEKLY_TARGET.names)
    return buckets.write_table(rows, path, ("week", "practitioner_id"), n)


def daily_with_target(spark: SparkSession, days: str, targets: str) -> DataFrame:
    """Stored daily sums with the stored targets of the same person and day, at any location."""
    daily = buckets.read_table(spark, days, schemas.PERSON_DAYS)
    wanted = buckets.read_table(spark, targets, schemas.TARGET)
    named = daily.withColumnsRenamed({"actual_hour": "total_actual_hour", "total": "total_billing"})
    return joins.with_daily_target(named, buckets.beside(wanted))


def fact_performance(spark: SparkSession, days: str, targets: str, people: DataFrame, places: DataFrame) -> DataFrame:
    """The performance fact of the stored daily sums and targets; only the dimensions are moved."""
    daily = buckets.read_table(spark, days, schemas.PERSON_DAYS)
    wanted = buckets.read_table(spark, targets, schemas.TARGET)
    return facts.fact_performance(daily, buckets.beside(wanted), people, places)


def weekly_with_target(spark: SparkSession, weeks: str, targets: str, *cols: str) -> DataFrame:
    """Stored weekly sums with the stored weekly targets of the same person, one row per target row."""
    weekly = buckets.read_table(spark, weeks, schemas.WEEKS)
    wanted = buckets.read_table(spark, targets, schemas.WEEKLY_TARGET)
    return joins.with_weekly_target(weekly, buckets.beside(wanted), *cols)
