"""Data-quality checks. Each returns the offending rows with the reason, or the repaired table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions import dates, values


def hour_out_of_range(targets: DataFrame, low: float, high: float, col: str = "target_hour") -> DataFrame:
    return targets.where(~F.col(col).between(low, high) | F.col(col).isNull())


def bad_date_ranges(requests: DataFrame, as_of: dt.date) -> DataFrame:
    """Requests that end before they start, or start before ``as_of``."""
    reason = F.when(F.col("start_date") > F.col("end_date"), "end_before_start").when(
        F.col("start_date") < F.lit(as_of), "start_before_as_of"
    )
    return requests.withColumn("reason", reason).where(F.col("reason").isNotNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def bad_text(
    raw: DataFrame,
    schema: T.StructType,
    date_pattern: str = dates.PATTERNS["iso"],
    required: Sequence[str] = (),
    max_length: dict[str, int] | None = None,
    letters_only: Sequence[str] = (),
) -> DataFrame:
    """Raw text rows that a strict conversion to ``schema`` would not accept, with all reasons."""
    checks: list[Column] = []

    def check(failed: Column, reason: str, name: str) -> None:
        checks.append(F.when(failed, F.lit(f"{reason}:{name}")))

    for field in schema:
        text = F.col(field.name)
        if field.name in required:
            check(text.isNull(), "missing", field.name)
        if isinstance(field.dataType, T.DateType):
            check(text.isNotNull() & dates.try_parse_date(text, date_pattern).isNull(), "not_a_date", field.name)
        elif not isinstance(field.dataType, T.StringType):
            check(text.isNotNull() & text.try_cast(field.dataType).isNull(), "not_a_number", field.name)
    for name, limit in (max_length or {}).items():
        check(F.length(name) > limit, "too_long", name)
    for name in letters_only:
        check(~F.col(name).rlike("^[A-Za-z]+$"), "not_letters", name)
    # Exploding the text, or nothing where it is empty, evaluates the checks once per row; a filter on
    # the text would be moved below its projection and evaluate them twice.
    found = F.array_remove(F.array(F.concat_ws(",", *checks)), "")
    return raw.select("*", F.explode(found).alias("reasons"))


def bad_ids(raw: DataFrame, col: str) -> DataFrame:
    """Rows whose id text is not a whole number above zero."""
    number = values.try_to_id(col)
    return raw.where(number.isNull() | (number <= 0))


def collapse_daily_targets(raw: DataFrame) -> DataFrame:
    """Several target rows of a person and day as one row with their sum."""
    return raw.groupBy("practitioner_id", "target_date").agg(F.sum("target_hour").alias("target_hour"))
