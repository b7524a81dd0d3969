"""Target planning: setting, cloning, editing and viewing daily target hours in bulk.

Each operation is one plan over all selected people and days. Person-days are made by exploding the
days of the range on each person, never by a cross join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions import dates
from shiftledger.operators.aggregates import latest_date
from shiftledger.operators.aggregates import last_writer
from shiftledger.operators.changes import one_per_key, upsert
from shiftledger.operators.filters import between_dates, pick_group, weekday_in_plan
from shiftledger.operators.joins import PERSON_DAY, person_days, with_practitioner_details
from shiftledger.operators.ordering import by_name_and_date

PLANNED = ("practitioner_id", "practitioner_name", "target_date", "target_hour")


def _with_status(
    slots: DataFrame, targets: DataFrame, holidays: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Mark each person-day as holiday, conflict or inserted; a holiday is told before a conflict.

    The holidays of the range are broadcast: they are at most its number of days.
    """
    closed = between_dates(holidays, "holiday_date", start, end).select(
        F.col("holiday_date").alias("target_date"), F.lit(True).alias("_closed")
    )
    taken = (
        between_dates(targets, "target_date", start, end)
        .select(*PERSON_DAY)
        .distinct()
        .withColumn("_taken", F.lit(True))
    )
    return (
        slots.join(F.broadcast(closed.distinct()), "target_date", "left")
        .join(taken, list(PERSON_DAY), "left")
        .withColumn(
            "status",
            F.when(F.col("_closed"), "holiday").when(F.col("_taken"), "conflict").otherwise("inserted"),
        )
        .drop("_closed", "_taken")
    )


def set_weekday_plan(
    people: DataFrame,
    targets: DataFrame,
    holidays: DataFrame,
    start: dt.date,
    end: dt.date,
    plan: dict[str, float],
) -> DataFrame:
    """Every planned day of every person with its hour and status."""
    slots = weekday_in_plan(
        person_days(people.select("practitioner_id", "practitioner_name"), start, end), "target_date", plan
    )
    return _with_status(slots, targets, holidays, start, end).select(*PLANNED, "status")


def inserted(planned: DataFrame, updated_at: Column) -> DataFrame:
    """The rows to add to the target table."""
    return planned.where(F.col("status") == "inserted").select(*PLANNED, updated_at.alias("updated_at"))


def status_counts(planned: DataFrame) -> DataFrame:
    """Number of rows inserted, in conflict and skipped as holidays."""
    return planned.groupBy("status").agg(F.count("*").alias("row_count"))


def people_with_targets(
    targets: DataFrame,
    practitioner: DataFrame,
    start: dt.date,
    end: dt.date,
    location: str | None = None,
    manager: str | None = None,
) -> DataFrame:
    """People of the group who have a target in the range."""
    active = between_dates(targets, "target_date", start, end).select("practitioner_id")
    return pick_group(practitioner, location, manager).join(active, "practitioner_id", "left_semi")


def set_constant(
    targets: DataFrame,
    practitioner: DataFrame,
    start: dt.date,
    end: dt.date,
    hour: float,
    updated_at: Column,
    location: str | None = None,
    manager: str | None = None,
) -> DataFrame:
    """The target table after giving one hour to every day of the range for each active person."""
    people = people_with_targets(targets, practitioner, start, end, location, manager)
    change = person_days(people.select("practitioner_id", "practitioner_name"), start, end).select(
        *PERSON_DAY,
        "practitioner_name",
        F.lit(hour).cast("decimal(5,1)").alias("target_hour"),
        updated_at.alias("updated_at"),
    )
    return upsert(targets, change)


def latest_week(targets: DataFrame) -> DataFrame:
    """The targets of the Monday-to-Sunday week that holds the newest target."""
    newest = latest_date(targets).scalar()
    monday, sunday = dates.week_bounds(newest)
    return targets.where(F.col("target_date").between(monday, sunday))


def clone_latest_week(
    people: DataFrame, targets: DataFrame, holidays: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """The newest week repeated over the range, with a status per person-day.

    A weekday without a target in that week gives no insert.
    """
    pattern = (
        latest_week(targets)
        .groupBy("practitioner_id", dates.weekday_index("target_date").alias("_weekday"))
        .agg(F.max_by("target_hour", "target_date").alias("target_hour"))
    )
    slots = person_days(people.select("practitioner_id", "practitioner_name"), start, end).withColumn(
        "_weekday", dates.weekday_index("target_date")
    )
    marked = _with_status(
        slots.join(pattern, ["practitioner_id", "_weekday"], "left"), targets, holidays, start, end
    )
    return marked.where((F.col("status") != "inserted") | F.col("target_hour").isNotNull()).select(*PLANNED, "status")


def aligned_source(start: dt.date, end: dt.date, option: str) -> tuple[Column, Column]:
    """First and last day to copy from.

    ``last_week`` goes back seven days; ``last_month`` and ``last_year`` find the same occurrence of the
    weekday in that month. Null when the month has no such day.
    """
    if option == "last_week":
        return F.date_sub(F.lit(start), 7), F.date_sub(F.lit(end), 7)
    back = {"last_month": "month", "last_year": "year"}
    if option not in back:
        raise ValueError(f"unknown clone option {option!r}")
    month = dates.same_day_before(back[option], dt.date(start.year, start.month, 1))
    first = dates.nth_weekday_in_month(month, dates.weekday_index(start), dates.week_of_month(start))
    return first, F.date_add(first, (end - start).days)


def clone_aligned(
    people: DataFrame, targets: DataFrame, start: dt.date, end: dt.date, option: str
) -> DataFrame:
    """Targets of an earlier range shifted onto this one.

    Per person it is all or nothing: any target in the range gives one ``conflict`` row, an empty
    source one ``no_source`` row, otherwise each copied day is ``cloned``.
    """
    first, last = aligned_source(start, end, option)
    busy = (
        between_dates(targets, "target_date", start, end)
        .select("practitioner_id")
        .distinct()
        .withColumn("_busy", F.lit(True))
    )
    source = targets.where(F.col("target_date").between(first, last)).select(
        "practitioner_id",
        F.date_add("target_date", F.date_diff(F.lit(start), first)).alias("_day"),
        F.col("target_hour").alias("_hour"),
    )
    marked = people.select("practitioner_id", "practitioner_name").join(busy, "practitioner_id", "left")
    conflicts = marked.where("_busy").select(
        "practitioner_id",
        "practitioner_name",
        F.lit(None).cast("date").alias("target_date"),
        F.lit(None).cast("decimal(5,1)").alias("target_hour"),
        F.lit("conflict").alias("status"),
    )
    clones = (
        marked.where(F.col("_busy").isNull())
        .join(source, "practitioner_id", "left")
        .select(
            "practitioner_id",
            "practitioner_name",
            F.col("_day").alias("target_date"),
            F.col("_hour").alias("target_hour"),
            F.when(F.col("_day").isNull(), "no_source").otherwise("cloned").alias("status"),
        )
    )
    return conflicts.unionByName(clones)


def apply_clones(targets: DataFrame, clones: DataFrame, updated_at: Column) -> DataFrame:
    """The target table after the cloned rows are written."""
    change = clones.where(F.col("status") == "cloned").select(*PLANNED, updated_at.alias("updated_at"))
    return upsert(targets, change)


def load_period(
    targets: DataFrame,
    practitioner: DataFrame,
    kind: str,
    as_of: dt.date,
    manager: str | None = None,
    max_date: dt.date | None = None,
) -> DataFrame:
    """Targets of the full week, month, quarter or year before ``as_of``, optionally of one manager."""
    start, end = dates.previous_period(kind, as_of)
    rows = between_dates(targets, "target_date", start, end)
    if max_date is not None:
        rows = rows.where(F.col("target_date") <= F.lit(max_date))
    people = practitioner.select("practitioner_id", "manager_name")
    if manager:
        people = people.where(F.col("manager_name") == manager)
    return rows.join(people, "practitioner_id").select(
        "manager_name", "practitioner_id", "practitioner_name", "target_date", "target_hour"
    )


def clone_over_range(
    targets: DataFrame, source: DataFrame, start: dt.date, end: dt.date, updated_at: Column
) -> DataFrame:
    """The target table after each person's newest source hour is written on every day of the range."""
    order = ["target_date", "target_hour", "practitioner_name"]
    hours = last_writer(source.select("practitioner_id", *order), ["practitioner_id"], order)
    hours = hours.drop("target_date")  # one row per person, also after a change of name
    change = person_days(hours, start, end).withColumn("updated_at", updated_at)
    return upsert(targets, change)


def consolidated(targets: DataFrame, people: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """All targets of the people in the range with their current name, sorted."""
    rows = with_practitioner_details(
        between_dates(targets, "target_date", start, end), people.select("practitioner_id", "practitioner_name")
    )
    return by_name_and_date(rows.select(*PLANNED))


def series(targets: DataFrame, people: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Target hours over time per person, in drawing order."""
    return consolidated(targets, people, start, end).select("practitioner_name", "target_date", "target_hour")


def edit_changes(targets: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose hour differs from the stored one, with both hours."""
    stored = targets.select(*PERSON_DAY, F.col("target_hour").alias("old_hour"))
    changed = edits.select(*PERSON_DAY, F.col("target_hour").alias("new_hour"))
    return stored.join(changed, list(PERSON_DAY)).where(~F.col("new_hour").eqNullSafe(F.col("old_hour")))


def edit_all(
    targets: DataFrame, people: DataFrame, start: dt.date, end: dt.date, hour: float, updated_at: Column
) -> DataFrame:
    """The target table after one hour is written to all targets of the people in the range.

    The rows are changed where they stand: the only join is with the people.
    """
    picked = people.select(F.col("practitioner_id").alias("_id")).distinct()
    hit = F.col("_id").isNotNull() & F.col("target_date").between(F.lit(start), F.lit(end))
    news = {"target_hour": F.lit(hour).cast("decimal(5,1)"), "updated_at": updated_at}
    joined = targets.join(picked, F.col("practitioner_id") == F.col("_id"), "left")
    return joined.select(*[F.when(hit, news[c]).otherwise(F.col(c)).alias(c) if c in news else c for c in targets.columns])


WEEKLY_KEY = ("practitioner_id", "week", "appt_type")


def update_weekly_targets(weekly_target: DataFrame, change: DataFrame) -> DataFrame:
    """Weekly targets after a change of income and hours, with a status per row.

    Rows are ``kept`` or ``updated``, also to null; a change whose key does not exist is ``rejected``. Of several
    changes of a key the last by ``updated_at`` counts, or without that column the greatest. Only the change is
    shuffled while it is small enough to be broadcast.
    """
    last = one_per_key(change, WEEKLY_KEY)
    news = last.select(
        *WEEKLY_KEY, F.col("target_income").alias("_income"), F.col("target_hour").alias("_hour"), F.lit(True).alias("_new")
    )
    stored = weekly_target.join(news, list(WEEKLY_KEY), "left").select(
        *WEEKLY_KEY,
        F.when(F.col("_new"), F.col("_income")).otherwise(F.col("target_income")).alias("target_income"),
        F.when(F.col("_new"), F.col("_hour")).otherwise(F.col("target_hour")).alias("target_hour"),
        F.when(F.col("_new"), "updated").otherwise("kept").alias("status"),
    )
    rejected = last.join(weekly_target.select(*WEEKLY_KEY), list(WEEKLY_KEY), "left_anti").select(
        *WEEKLY_KEY, "target_income", "target_hour", F.lit("rejected").alias("status")
    )
    return stored.unionByName(rejected)
