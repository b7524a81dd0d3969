"""Grouped aggregates. Every one is decomposable, so partial sums are built before the shuffle and
a key that holds a large share of the rows reaches its reducer as a few partial rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions import dates


def daily_actuals(rows: DataFrame) -> DataFrame:
    """Hours and billing per day, staff member and location."""
    return rows.groupBy("purchase_date", "staff_id", "location").agg(
        F.sum("actual_hour").alias("total_actual_hour"),
        F.sum("total").alias("total_billing"),
    )


def distinct_members(rows: DataFrame, col: str) -> DataFrame:
    return rows.select(col).where(F.col(col).isNotNull()).distinct()


def sorted_values(rows: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values in order."""
    return distinct_members(rows, col).orderBy(col)


def weekly_performance(perf: DataFrame, *by: str) -> DataFrame:
    """Hours and income per ISO week and the given columns. Equal weeks of different years merge."""
    return perf.groupBy(dates.iso_week("appt_date").alias("week"), *by).agg(
        F.sum("total_hours").alias("total_hours"),
        F.sum("total_income").alias("total_income"),
    )


def weekly_hours(perf: DataFrame) -> DataFrame:
    return perf.groupBy(dates.iso_week("appt_date").alias("week")).agg(F.sum("total_hours").alias("total_hours"))


def target_summary(targets: DataFrame, kind: str) -> DataFrame:
    """Target hours per calendar week, month, quarter or year, by the first day of the period."""
    return targets.groupBy(dates.period_start(kind, "target_date").alias("period")).agg(
        F.sum("target_hour").alias("total_target_hours")
    )


def max_loaded_date(fact: DataFrame, default: dt.date, col: str = "date") -> DataFrame:
    """The newest loaded date as one row, or a default for an empty table."""
    return fact.agg(F.coalesce(F.max(col), F.lit(default)).alias("mark"))


def latest_date(targets: DataFrame) -> DataFrame:
    return targets.agg(F.max("target_date").alias("target_date"))


def count_targets(people: DataFrame, targets: DataFrame) -> DataFrame:
    """Number of targets of each person, zero included."""
    counts = targets.groupBy("practitioner_id").agg(F.count("*").alias("existing_count"))
    return people.join(counts, "practitioner_id", "left").withColumn(
        "existing_count", F.coalesce("existing_count", F.lit(0))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Number of nulls in each column, as one row."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])


def last_writer(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key by the columns of ``order``, those of fixed width first.

    The fixed-width columns are packed into one number, whose maximum per key is a hashed aggregate with partial sums
    before the shuffle; neither it nor the join back has to sort or carry names. The number nearly always names one
    row. Rows that tie in it differ in other columns only, of which the greatest by ``order`` and the rest counts.
    """
    rest = [name for name in changes.columns if name not in keys]
    rank, packed = packed_rank(changes, order)
    marked = changes.withColumn("_rank", rank)
    newest = marked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_rank").alias("_newest"))
    # The maximum is reached where the rank is not below it; so written, the join is by the keys alone.
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_rank") >= F.col("_newest"))
    last = marked.join(newest, same).select(*changes.columns)
    first = [c for c in order if c not in packed]
    ties = F.sort_array(F.collect_set(F.struct(*first, *[c for c in rest if c not in first])), asc=False)
    return last.groupBy(*keys).agg(F.get(ties, F.lit(0)).alias("_last")).select(*keys, "_last.*").select(*changes.columns)


def packed_rank(df: DataFrame, order: list[str]) -> tuple[Column, list[str]]:
    """One number that sorts as the fixed-width columns of ``order`` do, nulls lowest, and the columns it holds.

    Columns are taken in order while their digits fit a 38-digit decimal.
    """
    rank, used, left = F.lit(0).cast("decimal(38,0)"), [], 38
    for name in order:
        found = _digits(F.col(name), df.schema[name].dataType)
        if found and found[1] <= left:
            value, digits = found
            scale = F.lit(Decimal(10) ** digits).cast("decimal(38,0)")
            rank = (rank * scale + F.coalesce(value.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
            used.append(name)
            left -= digits
    return rank, used


def _digits(col: Column, kind: T.DataType) -> tuple[Column, int] | None:
    """A positive whole number in the column's order and its digits; None for other types."""
    if isinstance(kind, T.DateType):
        return F.datediff(col, F.lit("0001-01-01").cast("date")) + 1, 7
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")) + 10**17, 18
    for whole, digits in ((T.ByteType, 3), (T.ShortType, 5), (T.IntegerType, 10), (T.LongType, 20)):
        if isinstance(kind, whole):
            return col.cast("decimal(38,0)") + F.lit(Decimal(10) ** digits / 2).cast("decimal(38,0)"), digits
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return col * 10**kind.scale + 10**kind.precision, kind.precision + 1
    return None
