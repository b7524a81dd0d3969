"""Performance dashboards: actual against target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions import dates
from shiftledger.functions.values import ratio
from shiftledger.operators.aggregates import weekly_performance
from shiftledger.operators.filters import row_security
from shiftledger.operators.joins import (
    with_weekly_target,
    with_weekly_target_any_type,
    with_weekly_type_target,
)
from shiftledger.operators.ordering import head
from shiftledger.plans.dimensions import attributes


def weekly_ratio(perf: DataFrame, weekly_target: DataFrame) -> DataFrame:
    """Weekly actuals per practitioner with the ratio to each weekly target row."""
    weekly = weekly_performance(perf, "practitioner_id")
    return with_weekly_target(weekly, weekly_target, "target_hour").withColumn(
        "performance_ratio", ratio("total_hours", "target_hour")
    )


def master_weekly(perf: DataFrame, weekly_target: DataFrame, person: str = "practitioner_id") -> DataFrame:
    """Weekly actuals with all target columns, one row per target row."""
    weekly = weekly_performance(perf, person)
    return weekly.join(weekly_target, ["week", person], "left").withColumn(
        "ratio_performance", ratio("total_hours", "target_hour")
    )


def master_totals(perf: DataFrame, weekly_target: DataFrame, person: str = "practitioner_id") -> DataFrame:
    """Totals per practitioner over all weeks of the master view.

    In that view a week with n target rows counts its actuals n times. The targets are summed per week
    with n first, and the actuals multiplied, so the repeated rows are never made.
    """
    weekly = weekly_performance(perf, person)
    wanted = weekly_target.groupBy("week", person).agg(
        F.sum("target_hour").alias("target_hours"),
        F.sum("target_income").alias("target_income"),
        F.count("*").alias("n"),
    )
    times = F.coalesce("n", F.lit(1))
    return _totals(
        weekly.join(wanted, ["week", person], "left").withColumns(
            {"total_hours": F.col("total_hours") * times, "total_income": F.col("total_income") * times}
        ),
        person,
    )


def _totals(weeks: DataFrame, person: str) -> DataFrame:
    return (
        weeks.groupBy(person)
        .agg(
            F.sum("total_hours").cast("decimal(28,1)").alias("total_hours"),
            F.sum("total_income").cast("decimal(32,2)").alias("total_income"),
            F.sum("target_hours").cast("decimal(28,1)").alias("target_hours"),
            F.sum("target_income").cast("decimal(32,2)").alias("target_income"),
        )
        .withColumn("ratio_performance", ratio("total_hours", "target_hours"))
    )


def practitioner_totals(perf: DataFrame, weekly_target: DataFrame) -> DataFrame:
    """The four totals of the master view without the ratio."""
    return master_totals(perf, weekly_target).drop("ratio_performance")


def targets_per_week(weekly_target: DataFrame) -> DataFrame:
    """One target row per practitioner and week: the sum over appointment types."""
    return weekly_target.groupBy("week", "practitioner_id").agg(
        F.sum("target_income").alias("target_income"), F.sum("target_hour").alias("target_hour")
    )


def master_totals_dedup(perf: DataFrame, weekly_target: DataFrame) -> DataFrame:
    """Totals in which each week counts once."""
    weekly = weekly_performance(perf, "practitioner_id")
    wanted = targets_per_week(weekly_target).withColumnRenamed("target_hour", "target_hours")
    return _totals(weekly.join(wanted, ["week", "practitioner_id"], "left"), "practitioner_id")


def weekly_by_type(perf: DataFrame) -> DataFrame:
    return weekly_performance(perf, "practitioner_id", "appt_type")


def practitioner_weekly_type(
    perf: DataFrame, weekly_target: DataFrame, role: str, practitioner_id: int | None = None
) -> DataFrame:
    """What a user may see by week and type, against the targets of every type of the week."""
    mine = weekly_by_type(row_security(perf, role, practitioner_id))
    wanted = row_security(weekly_target, role, practitioner_id)
    return with_weekly_target_any_type(mine, wanted).withColumn(
        "performance_ratio", ratio("total_hours", "target_hour")
    )


def practitioner_null_profile(perf, weekly_target, role, practitioner_id=None) -> DataFrame:
    """Nulls in each column of ``practitioner_weekly_type``, without making its rows.

    A person's week gives actual types x target types rows, so each side is counted per week and person and the
    counts are multiplied; a week without a target gives its actual rows once, with nulls for the target.
    """
    key = ["week", "practitioner_id"]
    actual = weekly_by_type(row_security(perf, role, practitioner_id))
    wanted = row_security(weekly_target, role, practitioner_id)

    def nulls(df: DataFrame, *names: str) -> list[Column]:
        return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names if c in df.columns]

    rows = F.count(F.lit(1))
    of_actual = actual.groupBy(*key).agg(
        rows.alias("a"),
        F.count_if(F.col("total_hours").isNotNull()).alias("with_hours"),
        *nulls(actual, "appt_type", "total_hours", "total_income"),
    )
    of_wanted = wanted.groupBy(*key).agg(
        rows.alias("b"),
        F.count_if(F.col("target_hour") != 0).alias("with_target"),
        F.count_if(F.col("appt_type").isNull()).alias("null_appt_type_target"),
        *nulls(wanted, "target_income", "target_hour"),
    )
    both = of_actual.join(of_wanted, key, "left").withColumn("times", F.coalesce("b", F.lit(1)))
    counts = {
        "week": F.when(F.col("week").isNull(), F.col("a") * F.col("times")),
        "practitioner_id": F.when(F.col("practitioner_id").isNull(), F.col("a") * F.col("times")),
        "appt_type_actual": F.col("null_appt_type") * F.col("times"),
        "total_hours": F.col("null_total_hours") * F.col("times"),
        "total_income": F.col("null_total_income") * F.col("times"),
        "appt_type_target": F.col("a") * F.coalesce("null_appt_type_target", F.lit(1)),
        "target_income": F.col("a") * F.coalesce("null_target_income", F.lit(1)),
        "target_hour": F.col("a") * F.coalesce("null_target_hour", F.lit(1)),
        "performance_ratio": F.col("a") * F.col("times") - F.col("with_hours") * F.coalesce("with_target", F.lit(0)),
    }
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(name) for name, n in counts.items()])


def practitioner_by_type(
    perf: DataFrame, weekly_target: DataFrame, role: str, practitioner_id: int | None = None
) -> DataFrame:
    """What a user may see by week and type, against the target of the same type."""
    mine = weekly_by_type(row_security(perf, role, practitioner_id))
    return with_weekly_type_target(mine, row_security(weekly_target, role, practitioner_id))


def practitioner_week_head(perf: DataFrame, weekly_target: DataFrame, practitioner_id: int, n: int = 5) -> DataFrame:
    """The first weeks of a practitioner against the first rows of the own targets."""
    mine = row_security(perf, "secondary", practitioner_id)
    weeks = head(weekly_performance(mine, "practitioner_id").drop("total_income"), n, "week")
    wanted = head(row_security(weekly_target, "secondary", practitioner_id), n, "week", "appt_type")
    return weeks.join(wanted, ["week", "practitioner_id"], "left").withColumn(
        "performance_ratio", ratio("total_hours", "target_hour")
    )


def by_location_manager_staff(fact: DataFrame, dim_practitioner: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Actual and target hours by location, manager and practitioner with subtotals.

    ``level`` tells how many of the three a row is of: 0 is the total, 3 a single practitioner. A member without
    a name so differs from a subtotal. The facts are summed per dimension key before the joins, and the subtotals are built on that
    small result.
    """
    summed = fact.groupBy("practitioner_dim_id", "location_id").agg(
        F.sum("actual_hour").alias("actual_hour"), F.sum("target_hour").alias("target_hour")
    )
    people = dim_practitioner.select("practitioner_dim_id", "manager_name", "practitioner_name")
    places = dim_location.select("location_id", "location_name")
    return (
        summed.join(people, "practitioner_dim_id")
        .join(places, "location_id")
        .rollup("location_name", "manager_name", "practitioner_name")
        .agg(
            F.sum("actual_hour").cast("decimal(28,1)").alias("actual_hour"),
            F.sum("target_hour").cast("decimal(28,1)").alias("target_hour"),
            (3 - F.bit_count(F.grouping_id())).cast("int").alias("level"),
        )
        .withColumn("performance_ratio", ratio("actual_hour", "target_hour"))
    )


def by_period(fact: DataFrame, kinds: tuple[str, ...] = dates.PERIODS) -> DataFrame:
    """Actual and target hours per calendar week, month, quarter and year.

    The facts are read once and summed per day; each day then counts for its period of every kind.
    """
    daily = fact.groupBy("date").agg(
        F.sum("actual_hour").alias("actual_hour"), F.sum("target_hour").alias("target_hour")
    )
    periods = F.array(
        *[F.struct(F.lit(k).alias("period_type"), dates.period_start(k, "date").alias("period_start")) for k in kinds]
    )
    return (
        daily.select("actual_hour", "target_hour", F.inline(periods))
        .groupBy("period_type", "period_start")
        .agg(
            F.sum("actual_hour").cast("decimal(28,1)").alias("actual_hour"),
            F.sum("target_hour").cast("decimal(28,1)").alias("target_hour"),
        )
        .withColumn("performance_ratio", ratio("actual_hour", "target_hour"))
    )


def by_calendar(fact: DataFrame, *names: str) -> DataFrame:
    """Actual and target hours by attributes of the date dimension, such as year and quarter.

    The attributes follow from the day, so they are computed for the few days and no date dimension is joined.
    """
    daily = fact.groupBy("date").agg(
        F.sum("actual_hour").alias("actual_hour"), F.sum("target_hour").alias("target_hour")
    )
    known = attributes("date")
    return (
        daily.where(F.col("date").isNotNull())
        .withColumns({name: known[name] for name in names})
        .groupBy(*names)
        .agg(
            F.sum("actual_hour").cast("decimal(28,1)").alias("actual_hour"),
            F.sum("target_hour").cast("decimal(28,1)").alias("target_hour"),
        )
        .withColumn("performance_ratio", ratio("actual_hour", "target_hour"))
    )
