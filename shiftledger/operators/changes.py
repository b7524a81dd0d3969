"""Table changes as functions ``(current, change) -> next``.

The current table is the large side and the change the small one. Every operator joins the current
table to the keys of the change, so a small change is broadcast and the current table is not shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.operators.aggregates import last_writer
from shiftledger.operators.joins import PERSON_DAY


def one_per_key(change: DataFrame, keys: Sequence[str], order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """The last change of each key by ``order``, as far as the change has those columns; ties and changes without
    them go to the greatest other values, numbers and dates before texts. Repeated keys so leave one row, whatever the
    order of the input."""
    first = [c for c in order if c in change.columns]
    rest = [c for c in change.columns if c not in keys and c not in first]
    return last_writer(change, list(keys), [*first, *rest])


def upsert(current: DataFrame, change: DataFrame, keys: Sequence[str] = PERSON_DAY) -> DataFrame:
    """Insert the change, replacing rows with the same key; of repeated keys in the change the last counts."""
    change = one_per_key(change, keys)
    kept = current.join(change.select(*keys), list(keys), "left_anti")
    return kept.select(*current.columns).unionByName(change.select(*current.columns))


def upsert_log(
    current: DataFrame, changes: DataFrame, keys: Sequence[str] = PERSON_DAY, order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """Upsert of a change log that may hold several changes per key; the last one wins."""
    return upsert(current, one_per_key(changes, keys, order), keys)


def update(
    current: DataFrame, change: DataFrame, values: Sequence[str], keys: Sequence[str] = PERSON_DAY
) -> DataFrame:
    """Overwrite ``values`` where the key matches; changes without a match are ignored.

    Of repeated keys in the change the last counts.
    """
    news = one_per_key(change, keys).select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = current.join(news, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in current.columns
        ]
    )


def delete_keys(current: DataFrame, keys: DataFrame, on: Sequence[str] = PERSON_DAY) -> DataFrame:
    """Remove the rows whose key is listed."""
    return current.join(keys.select(*on), list(on), "left_anti").select(*current.columns)


def delete_range(current: DataFrame, people: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Remove the targets of the given people dated in the range."""
    gone = people.select(F.col("practitioner_id").alias("_id"))
    hit = (F.col("practitioner_id") == F.col("_id")) & F.col("target_date").between(F.lit(start), F.lit(end))
    return current.join(gone, hit, "left_anti")
