"""Sorts and heads. Each sort ends in a tie-breaker, so the order is total and a frequent value is
spread over several range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_date(targets: DataFrame) -> DataFrame:
    return targets.orderBy("target_date", "practitioner_id")


def by_name_and_date(targets: DataFrame) -> DataFrame:
    return targets.orderBy("practitioner_name", "target_date", "practitioner_id")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)
