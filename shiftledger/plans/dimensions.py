"""Dimension builds: calendar, location, item and the practitioner dimension with history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import schemas
from shiftledger.functions import dates, values
from shiftledger.operators.aggregates import distinct_members
from shiftledger.operators.filters import with_dimension_defaults
from shiftledger.operators.joins import changed_practitioners, new_members, newest_key
from shiftledger.operators.keys import surrogate_keys

PERSON = ("practitioner_id", "practitioner_name", "manager_name", "location_name")


def calendar(days: DataFrame, col: str = "date") -> DataFrame:
    """Calendar attributes of every given day."""
    return days.select(F.col(col).alias("date"), *[value.alias(name) for name, value in attributes(col).items()])


def attributes(col: str = "date") -> dict[str, Column]:
    """The attributes of a day in the date dimension, by name."""
    return {
        "day_of_week": dates.padded_day_name(col),
        "week_of_year": dates.iso_week(col),
        "month": F.month(col),
        "quarter": F.quarter(col),
        "year": F.year(col),
    }


def dim_date(rows: DataFrame, col: str) -> DataFrame:
    """The calendar of all years that ``rows`` touch."""
    first = F.trunc(F.min(col), "year")
    last = dates.period_end("year", F.max(col))
    days = rows.agg(first.alias("first"), last.alias("last"))
    return calendar(days.select(F.explode(dates.days_between("first", "last")).alias("date")))


def dim_date_between(one_row: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The calendar of a given range; ``one_row`` is any one-row frame of the session."""
    return calendar(one_row.select(F.explode(dates.days_between(start, end)).alias("date")))


def add_locations(dim: DataFrame, rows: DataFrame) -> DataFrame:
    """New location rows for the names that ``rows`` hold and ``dim`` does not."""
    return _add_members(dim, rows, "location", schemas.DIM_LOCATION)


def add_items(dim: DataFrame, rows: DataFrame) -> DataFrame:
    """New item rows for the names that ``rows`` hold and ``dim`` does not."""
    return _add_members(dim, rows, "item", schemas.DIM_ITEM)


def first_locations(rows: DataFrame) -> DataFrame:
    return _first_members(rows, "location", schemas.DIM_LOCATION)


def first_items(rows: DataFrame) -> DataFrame:
    return _first_members(rows, "item", schemas.DIM_ITEM)


def _first_members(rows: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    names = distinct_members(rows, col).toDF(f"{col}_name")
    return fill(surrogate_keys(names, [f"{col}_name"], f"{col}_id"), schema)


def _add_members(dim: DataFrame, rows: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    names = new_members(distinct_members(rows, col), dim, col, f"{col}_name").toDF(f"{col}_name")
    return fill(surrogate_keys(names, [f"{col}_name"], f"{col}_id", max_key(dim, f"{col}_id")), schema)


def max_key(dim: DataFrame, key: str):
    """The highest key in use, zero for an empty table, as a scalar subquery."""
    return dim.agg(F.coalesce(F.max(key), F.lit(0))).scalar()


def fill(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; those that ``df`` lacks are null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


MEMBER_COLUMNS = ("staff_id", "staff_name", "manager", "location", "item")


def members(rows: DataFrame) -> DataFrame:
    """The distinct dimension members of landing rows with the newest day of each.

    It has the columns of landing rows, so every dimension can be built from it; one pass over the
    appointments then serves them all.
    """
    cols = [name for name in MEMBER_COLUMNS if name in rows.columns]
    return rows.groupBy(*cols).agg(F.max("purchase_date").alias("purchase_date"))


def people_of(rows: DataFrame) -> DataFrame:
    """Distinct practitioners under dimension names."""
    return (
        rows.where(F.col("staff_id").isNotNull())
        .select(
            F.col("staff_id").alias("practitioner_id"),
            F.col("staff_name").alias("practitioner_name"),
            F.col("manager").alias("manager_name"),
            F.col("location").alias("location_name"),
        )
        .distinct()
    )


def distinct_practitioners(rows: DataFrame, dim_location: DataFrame, email_domain: str) -> DataFrame:
    """Distinct practitioners with address and location key; unknown locations are dropped."""
    return _with_details(people_of(rows), dim_location, email_domain)


def _with_details(people: DataFrame, dim_location: DataFrame, email_domain: str) -> DataFrame:
    located = people.join(dim_location.select("location_id", "location_name"), "location_name")
    return with_dimension_defaults(
        located.withColumn("email", values.email("practitioner_name", email_domain))
    )


def first_practitioners(rows: DataFrame, dim_location: DataFrame, email_domain: str) -> DataFrame:
    """Initial load: every distinct practitioner row is current."""
    people = distinct_practitioners(rows, dim_location, email_domain)
    return fill(surrogate_keys(people, PERSON, "practitioner_dim_id"), schemas.DIM_PRACTITIONER)


def latest_people(rows: DataFrame) -> DataFrame:
    """The newest row of each practitioner; of several on one day the greatest by manager, location and name.

    Equal rows of a person are merged first with a plain maximum, then the newest day of each person is joined back.
    What is left are the versions of one person on one day, a handful, of which the greatest is picked. All groupings
    are hashed; none has to sort names.
    """
    versions = (
        rows.where(F.col("staff_id").isNotNull())
        .groupBy("staff_id", "staff_name", "manager", "location")
        .agg(F.max("purchase_date").alias("seen"))
    )
    newest = versions.groupBy(F.col("staff_id").alias("_id")).agg(F.max("seen").alias("_newest"))
    last = versions.join(newest, (F.col("staff_id") == F.col("_id")) & F.col("seen").eqNullSafe(F.col("_newest")))
    found = F.sort_array(F.collect_set(F.struct("manager", "location", "staff_name")), asc=False)
    return last.groupBy("staff_id").agg(F.get(found, F.lit(0)).alias("v")).select(
        F.col("staff_id").alias("practitioner_id"),
        F.col("v.staff_name").alias("practitioner_name"),
        F.col("v.manager").alias("manager_name"),
        F.col("v.location").alias("location_name"),
    )


def merge_practitioners(
    dim: DataFrame, rows: DataFrame, dim_location: DataFrame, email_domain: str, batch_date: dt.date
) -> DataFrame:
    """The practitioner dimension after a batch.

    A practitioner new under a manager gets a new current version; versions that have a newer current
    one are closed. Only the newest row of each practitioner in the batch counts, so loading the same
    batch twice changes nothing. A change of location alone makes no version.
    """
    changed = changed_practitioners(latest_people(rows), dim)
    detailed = _with_details(changed, dim_location, email_domain).withColumn(
        "effective_start_date", F.lit(batch_date)
    )
    keyed = surrogate_keys(detailed, PERSON, "practitioner_dim_id", max_key(dim, "practitioner_dim_id"))
    closed = close_superseded(dim, detailed, batch_date)
    return closed.unionByName(fill(keyed, schemas.DIM_PRACTITIONER))


def close_superseded(dim: DataFrame, newcomers: DataFrame, batch_date: dt.date) -> DataFrame:
    """Close the current versions of ``dim`` that a newcomer or a newer current version replaces."""
    replaced = newcomers.select("practitioner_id", F.lit(True).alias("_replaced"))
    older = F.col("practitioner_dim_id") < F.col("newest_id")
    return (
        dim.join(newest_key(dim), "practitioner_id", "left")
        .join(replaced, "practitioner_id", "left")
        .withColumn("_closes", F.col("is_current") & (F.col("_replaced").isNotNull() | older))
        .withColumn(
            "effective_end_date",
            F.when(F.col("_closes"), F.date_sub(F.lit(batch_date), 1)).otherwise(F.col("effective_end_date")),
        )
        .withColumn("is_current", F.col("is_current") & ~F.col("_closes"))
        .select(*schemas.DIM_PRACTITIONER.names)
    )


def latest_versions(dim: DataFrame) -> DataFrame:
    """The newest current version of each practitioner."""
    newest = newest_key(dim).withColumnRenamed("newest_id", "practitioner_dim_id")
    return dim.join(newest, ["practitioner_id", "practitioner_dim_id"], "left_semi")
