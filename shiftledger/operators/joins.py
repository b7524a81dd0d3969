"""Joins between facts, dimensions, targets and plans.

Dimensions grow with the data, so none is broadcast by hint: the planner broadcasts them below its
size threshold, and above it a sort-merge join with skew splitting takes over. Hints are given only
where the size has a bound, as for the days of a known range.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions import dates

PERSON_DAY = ("practitioner_id", "target_date")


def with_location(rows: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Location key by name; rows of unknown locations are dropped."""
    dim = dim_location.select("location_id", F.col("location_name").alias("location"))
    return rows.join(dim, "location")


def with_practitioner(rows: DataFrame, dim_practitioner: DataFrame) -> DataFrame:
    """Key of each current version of the staff member. Several current versions repeat the row."""
    dim = dim_practitioner.where("is_current").select(
        "practitioner_dim_id", F.col("practitioner_id").alias("staff_id")
    )
    return rows.join(dim, "staff_id")


def with_item(rows: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Item key by name; rows without an item are dropped."""
    dim = dim_item.select("item_id", F.col("item_name").alias("item"))
    return rows.join(dim, "item")


def with_daily_target(daily: DataFrame, target: DataFrame) -> DataFrame:
    """Daily actuals with the targets of the same person and day, at any location."""
    wanted = target.select("staff_id", F.col("appt_date").alias("purchase_date"), "target_hour")
    return daily.join(wanted, ["staff_id", "purchase_date"], "left")


def with_practitioner_details(targets: DataFrame, practitioner: DataFrame) -> DataFrame:
    """Targets with the name, location and manager of the practitioner."""
    return targets.drop("practitioner_name").join(practitioner, "practitioner_id")


def with_weekly_target(weekly: DataFrame, weekly_target: DataFrame, *cols: str) -> DataFrame:
    """Weekly actuals with the weekly targets of the same person, one row per target row."""
    wanted = weekly_target.select("week", "practitioner_id", *cols)
    return weekly.join(wanted, ["week", "practitioner_id"], "left")


def with_weekly_type_target(weekly: DataFrame, weekly_target: DataFrame) -> DataFrame:
    """Weekly actuals by appointment type with the target of the same type."""
    return weekly.join(weekly_target, ["week", "practitioner_id", "appt_type"], "left")


def with_weekly_target_any_type(weekly: DataFrame, weekly_target: DataFrame) -> DataFrame:
    """Weekly actuals by type with the targets of every type of that person and week.

    Both sides hold one row per type, so a person's week gives at most types x types rows.
    """
    actual = weekly.withColumnRenamed("appt_type", "appt_type_actual")
    wanted = weekly_target.withColumnRenamed("appt_type", "appt_type_target")
    return actual.join(wanted, ["week", "practitioner_id"], "left")


def new_members(members: DataFrame, dim: DataFrame, member_col: str, dim_col: str) -> DataFrame:
    """Members that the dimension does not hold yet."""
    known = dim.select(F.col(dim_col).alias(member_col))
    return members.where(F.col(member_col).isNotNull()).join(known, member_col, "left_anti")


def changed_practitioners(people: DataFrame, dim_practitioner: DataFrame) -> DataFrame:
    """People without a current version under the same manager. A missing manager never matches."""
    current = dim_practitioner.where("is_current").select("practitioner_id", "manager_name")
    return people.join(current, ["practitioner_id", "manager_name"], "left_anti")


def without_target(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Person-days that have no target yet."""
    return slots.join(targets.select(*PERSON_DAY), list(PERSON_DAY), "left_anti")


def without_holiday(rows: DataFrame, holidays: DataFrame, col: str) -> DataFrame:
    """Rows not dated on a holiday."""
    closed = holidays.select(F.col("holiday_date").alias(col))
    return rows.join(closed, col, "left_anti")


def person_days(people: DataFrame, start: dt.date, end: dt.date, col: str = "target_date") -> DataFrame:
    """Each person on each day of a range. The days are exploded in place; nothing is shuffled."""
    return people.withColumn(col, F.explode(dates.days_between(start, end)))


def superseded(dim_practitioner: DataFrame) -> DataFrame:
    """Current versions that have a newer current version."""
    newest = newest_key(dim_practitioner)
    return (
        dim_practitioner.where("is_current")
        .join(newest, "practitioner_id")
        .where(F.col("practitioner_dim_id") < F.col("newest_id"))
        .drop("newest_id")
    )


def newest_key(dim_practitioner: DataFrame) -> DataFrame:
    """The newest current key of each practitioner."""
    return (
        dim_practitioner.where("is_current")
        .groupBy("practitioner_id")
        .agg(F.max("practitioner_dim_id").alias("newest_id"))
    )


def matching_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str] = PERSON_DAY) -> DataFrame:
    """Preview of the rows that a delete by key list removes."""
    return rows.join(keys.select(*on), list(on), "left_semi")
