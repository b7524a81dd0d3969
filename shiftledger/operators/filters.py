"""Projections and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions import dates
from shiftledger.functions.values import clean_name

ALL = "All"


def normalise_columns(df: DataFrame) -> DataFrame:
    """Snake-case column names without blanks, dots and signs."""
    return df.toDF(*[clean_name(name) for name in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def with_dimension_defaults(df: DataFrame) -> DataFrame:
    """The columns that a new practitioner row starts with."""
    return df.withColumns({"contract_type": F.lit(None).cast("string"), "is_current": F.lit(True)})


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def between_dates(df: DataFrame, col: str, start: dates.ColumnOrDate, end: dates.ColumnOrDate) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included."""
    return df.where(F.col(col).between(dates.as_col(start), dates.as_col(end)))


def pick_group(df: DataFrame, location: str | None = None, manager: str | None = None) -> DataFrame:
    """Rows of a location, or else of a manager; a location wins. None and "All" do not filter."""
    if location and location != ALL:
        return df.where(F.col("clinic_location") == location)
    if manager and manager != ALL:
        return df.where(F.col("manager_name") == manager)
    return df


def cascade(
    df: DataFrame,
    locations: Sequence[str] | DataFrame | None = None,
    managers: Sequence[str] | DataFrame | None = None,
    practitioners: Sequence[int] | DataFrame | None = None,
) -> DataFrame:
    """Narrow by locations, then managers, then practitioners.

    A selection is a short list, or a one-column DataFrame when it is long.
    """
    chosen = (("clinic_location", locations), ("manager_name", managers), ("practitioner_id", practitioners))
    for col, values in chosen:
        if isinstance(values, DataFrame):
            df = df.join(values.toDF(col), col, "left_semi")
        elif values is not None:
            df = df.where(F.col(col).isin(list(values)))
    return df


def row_security(df: DataFrame, role: str, practitioner_id: int | None = None) -> DataFrame:
    """All rows for a master, own rows for a secondary user, none for anyone else."""
    if role == "master":
        return df
    if role == "secondary" and practitioner_id is not None:
        return df.where(F.col("practitioner_id") == practitioner_id)
    return df.where(F.lit(False))


def entitled_rows(df: DataFrame, entitlements: DataFrame) -> DataFrame:
    """The rows that each user may see, for all users in one pass, with ``user_id``.

    ``entitlements`` holds user_id, role, practitioner_id and manager_name. A master sees all rows, a manager those of
    the named manager's practitioners, a secondary user those of the named practitioner; other roles, and roles without
    the id or name they need, see nothing. A user with several entitlements sees a row once. Each kind of entitlement
    is one join on its own key; masters' rows are asked for by a grouped list of them, so that no pair of rows is
    compared.
    """
    users = entitlements.select("user_id", "role", F.col("practitioner_id").alias("_person"), F.col("manager_name").alias("_manager"))
    own = users.where((F.col("role") == "secondary") & F.col("_person").isNotNull()).select("user_id", "_person").distinct()
    led = users.where((F.col("role") == "manager") & F.col("_manager").isNotNull()).select("user_id", "_manager").distinct()
    # Users by person and by manager: lists, so that every row is joined once and expanded at the end.
    by_person = own.groupBy("_person").agg(F.collect_set("user_id").alias("_by_person"))
    by_manager = led.groupBy("_manager").agg(F.collect_set("user_id").alias("_by_manager"))
    masters = users.where(F.col("role") == "master").agg(F.collect_set("user_id").alias("m"))
    no_one = F.array().cast(T.ArrayType(entitlements.schema["user_id"].dataType))
    seen = F.array_union(
        F.array_union(F.coalesce("_by_person", no_one), F.coalesce("_by_manager", no_one)), masters.scalar()
    )
    return (
        df.join(by_person, F.col("practitioner_id") == F.col("_person"), "left")
        .join(by_manager, F.col("manager_name") == F.col("_manager"), "left")
        .select(F.explode(seen).alias("user_id"), *[F.col(c) for c in df.columns])
    )


def entitled_totals(df: DataFrame, entitlements: DataFrame, *cols: str) -> DataFrame:
    """The number of rows that each user may see, as ``visible_rows``, and the sums of ``cols`` over them.

    The same as grouping ``entitled_rows`` by user, without a row per user and row: the rows are summed per person and
    manager, and shared out to every distinct entitlement rather than to every user, so a sum goes to its person, its
    manager and the masters, however many users hold these. Users then add up what they hold. A person's rows under a
    manager that a user is entitled to as well count with the manager, and masters by their own entitlement alone.
    """
    held = entitlements.select(
        "user_id",
        "role",
        F.when(F.col("role") == "secondary", F.col("practitioner_id")).alias("practitioner_id"),
        F.when(F.col("role") == "manager", F.col("manager_name")).alias("manager_name"),
    )
    named = (F.col("role") == "master") | F.col("practitioner_id").isNotNull() | F.col("manager_name").isNotNull()
    held = held.where(F.col("user_id").isNotNull() & named).distinct()
    masters = held.where(F.col("role") == "master")
    others = held.where(F.col("role") != "master").join(masters.select("user_id"), "user_id", "left_anti")
    right = F.struct("role", "practitioner_id", "manager_name")

    summed = df.groupBy("practitioner_id", "manager_name").agg(
        F.count(F.lit(1)).alias("visible_rows"), *[F.sum(c).alias(c) for c in cols]
    )
    rights = held.select(right.alias("user_id"), "role", "practitioner_id", "manager_name").distinct()
    own = F.col("user_id.role") == "secondary"
    # What a person's entitlement shows stays apart by manager, null where that does not matter.
    shown = (
        entitled_rows(summed, rights)
        .groupBy(F.col("user_id").alias("_right"), F.when(own, F.col("manager_name")).alias("_under"))
        .agg(*[F.sum(c).alias(c) for c in ("visible_rows", *cols)])
    )
    led = others.where(F.col("role") == "manager").select(F.col("user_id").alias("_user"), F.col("manager_name").alias("_led"))
    seen = (
        others.unionByName(masters)
        .select("user_id", right.alias("_right"))
        .join(shown, "_right")
        .join(led, (F.col("user_id") == F.col("_user")) & (F.col("_under") == F.col("_led")), "left_anti")
    )
    sums = [F.sum(c).cast(summed.schema[c].dataType).alias(c) for c in ("visible_rows", *cols)]
    return seen.groupBy("user_id").agg(*sums)


def weekday_in_plan(df: DataFrame, col: str, plan: dict[str, float]) -> DataFrame:
    """Rows whose weekday is planned, with the planned ``target_hour``.

    The plan has at most seven entries and is part of the expression, so no join is needed.
    """
    return df.withColumn("target_hour", dates.planned_hour(plan, col)).where(F.col("target_hour").isNotNull())


def after_mark(df: DataFrame, col: str, mark: DataFrame, lookback_days: int = 0) -> DataFrame:
    """Rows dated strictly after the one-row ``mark``.

    The mark is a scalar subquery: it is computed once and then filters the scan itself.
    """
    return df.where(F.col(col) > mark_date(mark, lookback_days))


def mark_date(mark: DataFrame, lookback_days: int = 0) -> Column:
    value = mark.scalar()
    return F.date_sub(value, lookback_days) if lookback_days else value


def exact_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")
