"""Wide to long and long to wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions import dates


def hours_long(weekly: DataFrame) -> DataFrame:
    """Actual and target hours as one row each per week and appointment type."""
    return weekly.unpivot(["week", "appt_type"], ["total_hours", "target_hour"], "hours_type", "hours")


def income_long(weekly: DataFrame) -> DataFrame:
    """Actual and target income as one row each per week and appointment type."""
    return weekly.unpivot(["week", "appt_type"], ["total_income", "target_income"], "income_type", "income")


def week_matrix(people: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per person with the target of each weekday of one week; null when missing.

    A person has one target per day, so a filtered maximum reads it off in a single grouping.
    """
    day = dates.day_name("target_date")
    matrix = targets.groupBy("practitioner_id").agg(
        *[F.max(F.when(day == name, F.col("target_hour"))).alias(name.lower()) for name in dates.WEEKDAYS]
    )
    return people.select("practitioner_id", "practitioner_name").join(matrix, "practitioner_id", "left")
