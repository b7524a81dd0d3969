"""Changes of the stored target table: copy on write by month.

The target table is kept by month (``sources/tables.py``). A change reads and writes the months that its keys fall into
and commits a new version; all other months keep their files, and readers see the old version until then. A
person-day's month is part of its key, so no other month can hold a matching row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from shiftledger import schemas
from shiftledger.operators import changes
from shiftledger.sources import tables

DATE = "target_date"


def write_targets(targets: DataFrame, path: str) -> tables.Manifest:
    """The whole target table as a new version."""
    return tables.write_table(targets.select(*schemas.TARGET_UPDATE.names), path, part=tables.month(DATE))


def read_targets(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, at: int | None = None
) -> DataFrame:
    """The target table, or the months that a range touches; rows of the range are for the caller to filter."""

    def wanted(part: str) -> bool:
        dated = part != tables.UNDATED
        return (start is None or dated and part >= f"{start:%Y-%m}") and (end is None or dated and part <= f"{end:%Y-%m}")

    return tables.read_table(spark, path, schemas.TARGET_UPDATE, at=at, wanted=wanted)


def upsert(spark: SparkSession, path: str, change: DataFrame) -> tables.Manifest | None:
    """Insert or replace rows by person and day."""
    months = tables.parts_of(change, tables.month(DATE))
    return _rewrite(spark, path, months, lambda current: changes.upsert(current, change))


def update(spark: SparkSession, path: str, change: DataFrame, values: Sequence[str]) -> tables.Manifest | None:
    """Overwrite ``values`` of the rows that the change names; months without stored rows are left out."""
    months = _stored(spark, path) & tables.parts_of(change, tables.month(DATE))
    return _rewrite(spark, path, months, lambda current: changes.update(current, change, values))


def delete_keys(spark: SparkSession, path: str, keys: DataFrame) -> tables.Manifest | None:
    """Remove the listed person-days."""
    months = _stored(spark, path) & tables.parts_of(keys, tables.month(DATE))
    return _rewrite(spark, path, months, lambda current: changes.delete_keys(current, keys))


def delete_range(
    spark: SparkSession, path: str, people: DataFrame, start: dt.date, end: dt.date
) -> tables.Manifest | None:
    """Remove the people's targets of a range of days."""
    months = {m for m in _stored(spark, path) - {tables.UNDATED} if f"{start:%Y-%m}" <= m <= f"{end:%Y-%m}"}
    return _rewrite(spark, path, months, lambda current: changes.delete_range(current, people, start, end))


def _stored(spark: SparkSession, path: str) -> set[str]:
    found = tables.manifest(spark, path)
    return set(found.parts) if found else set()


def _rewrite(
    spark: SparkSession, path: str, months: set[str], apply: Callable[[DataFrame], DataFrame]
) -> tables.Manifest | None:
    """The next version, with ``apply`` carried out on some months; None if there is none to change."""
    if not months:
        return None
    current = tables.read_table(spark, path, schemas.TARGET_UPDATE, wanted=months.__contains__)
    return tables.replace_parts(apply(current), path, tables.month(DATE), months)
