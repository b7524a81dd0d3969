"""Fact builds, full and incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import schemas
from shiftledger.functions.values import zero_if_null
from shiftledger.operators.aggregates import daily_actuals
from shiftledger.operators.filters import after_mark
from shiftledger.operators.joins import with_item, with_location, with_practitioner


def fact_performance(
    rows: DataFrame, target: DataFrame, dim_practitioner: DataFrame, dim_location: DataFrame
) -> DataFrame:
    """Target hours, actual hours and billing per day, practitioner version and location.

    The rows are summed per day, person and location before any join. The targets are summed per
    person and day with their number ``n``. A day that joins n target rows counts its actuals n times;
    that product is taken here instead of fanning the rows out and summing them again, so no grouping
    follows the joins.
    """
    keyed = with_practitioner(with_location(with_targets(rows, target), dim_location), dim_practitioner)
    return _as_fact(keyed, schemas.FACT_PERFORMANCE)


def with_targets(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Hours, billing and target hours per day, person and location; nulls count as zero."""
    wanted = target.groupBy("staff_id", F.col("appt_date").alias("purchase_date")).agg(
        F.sum("target_hour").alias("target_hour"), F.count("*").alias("n")
    )
    daily = daily_actuals(rows).join(wanted, ["staff_id", "purchase_date"], "left")
    times = F.coalesce("n", F.lit(1))
    return daily.select(
        F.col("purchase_date").alias("date"),
        "staff_id",
        "location",
        zero_if_null(F.col("target_hour")).alias("target_hour"),
        zero_if_null(F.col("total_actual_hour") * times).alias("actual_hour"),
        zero_if_null(F.col("total_billing") * times).alias("total_billing"),
    )


def fact_performance_dedup(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Per day and practitioner, with the target of a person's day counted once at any number of
    locations, versions or target rows."""
    daily = rows.groupBy(F.col("purchase_date").alias("date"), F.col("staff_id").alias("practitioner_id")).agg(
        F.sum("actual_hour").alias("actual_hour"), F.sum("total").alias("total_billing")
    )
    wanted = target.groupBy(F.col("appt_date").alias("date"), F.col("staff_id").alias("practitioner_id")).agg(
        F.max("target_hour").alias("target_hour")
    )
    return daily.join(wanted, ["date", "practitioner_id"], "left").select(
        "date",
        "practitioner_id",
        zero_if_null(F.col("target_hour")).cast(schemas.FACT_HOUR).alias("target_hour"),
        zero_if_null(F.col("actual_hour")).cast(schemas.FACT_HOUR).alias("actual_hour"),
        zero_if_null(F.col("total_billing")).cast(schemas.FACT_MONEY).alias("total_billing"),
    )
def day_totals(fact: DataFrame) -> DataFrame:
    """Hours and billing of the performance fact per day."""
    return _as_fact(
        fact.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("target_hour", "actual_hour", "total_billing")]),
        schemas.DAY_TOTALS,
    )


def first_day_totals(rows: DataFrame, target: DataFrame) -> DataFrame:
    """The day totals of a fact built from all of ``rows``, without its dimensions.

    After a first load every person of the rows has one current version and every location its row, so the joins with
    the dimensions keep exactly the rows that name both.
    """
    named = rows.where(F.col("staff_id").isNotNull() & F.col("location").isNotNull())
    return day_totals(_as_fact(with_targets(named, target), schemas.FACT_MEASURES))


def fact_appointments(
    rows: DataFrame, dim_practitioner: DataFrame, dim_location: DataFrame, dim_item: DataFrame
) -> DataFrame:
    """Appointments, hours and billing per day, practitioner version, location and item.

    The rows are summed by their natural keys first; each dimension key stands for one natural key,
    so the joins only translate the summed rows.
    """
    daily = (
        rows.where(F.col("item").isNotNull())
        .groupBy("purchase_date", "staff_id", "location", "item")
        .agg(
            F.count("item").alias("number_appointments"),
            F.sum("actual_hour").alias("actual_hour"),
            F.sum("total").alias("total_billing"),
        )
    )
    keyed = with_practitioner(with_item(with_location(daily, dim_location), dim_item), dim_practitioner)
    return _as_fact(
        keyed.select(
            F.col("purchase_date").alias("date"),
            "practitioner_dim_id",
            "location_id",
            "item_id",
            "number_appointments",
            zero_if_null(F.col("actual_hour")).alias("actual_hour"),
            zero_if_null(F.col("total_billing")).alias("total_billing"),
        ),
        schemas.FACT_APPOINTMENTS,
    )


def new_fact_performance(rows, target, dim_practitioner, dim_location, mark: DataFrame, lookback_days: int = 0):
    """The performance rows dated after the one-row ``mark``."""
    newer = after_mark(rows, "purchase_date", mark, lookback_days)
    return fact_performance(newer, target, dim_practitioner, dim_location)


def new_fact_appointments(rows, dim_practitioner, dim_location, dim_item, mark: DataFrame, lookback_days: int = 0):
    """The appointment rows dated after the one-row ``mark``."""
    newer = after_mark(rows, "purchase_date", mark, lookback_days)
    return fact_appointments(newer, dim_practitioner, dim_location, dim_item)


def _as_fact(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
