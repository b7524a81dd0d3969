"""Readers for the landing, planning and dashboard tables.

Parquet is read with its declared schema. CSV is read as text, its header names are normalised and
each declared column is converted, so blanks and dots in names or column order do not matter; all files
of one folder must have the same header.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import schemas
from shiftledger.functions import dates
from shiftledger.operators.filters import normalise_columns


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with header, every column as text under its normalised name.

    A file of the folder whose header differs from the others' raises when it is read.
    """
    return normalise_columns(spark.read.csv(path, header=True, enforceSchema=False))


def conform(
    df: DataFrame,
    schema: T.StructType,
    date_pattern: str | Mapping[str, str] = dates.PATTERNS["iso"],
    strict: bool = True,
) -> DataFrame:
    """Convert text columns to ``schema``. Columns that the file lacks become null.

    ``strict`` raises on malformed text; otherwise it becomes null for the quality checks to report.
    """
    present = set(df.columns)

    def converted(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            value = text
        elif isinstance(field.dataType, T.DateType):
            pattern = date_pattern if isinstance(date_pattern, str) else date_pattern[field.name]
            value = dates.parse_date(text, pattern) if strict else dates.try_parse_date(text, pattern)
        else:
            value = text.cast(field.dataType) if strict else text.try_cast(field.dataType)
        return value.alias(field.name)

    return df.select(*[converted(field) for field in schema])


def _read(spark, path, schema, format, date_pattern, strict, renames=None) -> DataFrame:
    if format == "parquet":
        return read_parquet(spark, path, schema)
    if format != "csv":
        raise ValueError(f"format must be parquet or csv, not {format!r}")
    text = read_csv_text(spark, path)
    return conform(text.withColumnsRenamed(dict(renames or {})), schema, date_pattern, strict)


def read_input(spark, path, format="parquet", date_pattern=dates.PATTERNS["long"], strict=True) -> DataFrame:
    """Appointment and billing rows."""
    return _read(spark, path, schemas.INPUT, format, date_pattern, strict)


def read_target(spark, path, format="parquet", date_pattern=dates.PATTERNS["long"], strict=True) -> DataFrame:
    """Daily target hours."""
    return _read(spark, path, schemas.TARGET, format, date_pattern, strict)


def read_practitioners(spark, path, format="parquet") -> DataFrame:
    return _read(spark, path, schemas.PRACTITIONER, format, dates.PATTERNS["iso"], True)


def read_target_updates(spark, path, format="parquet", date_pattern=dates.PATTERNS["iso"]) -> DataFrame:
    return _read(spark, path, schemas.TARGET_UPDATE, format, date_pattern, True)


def read_performance(spark, path, format="parquet", date_pattern=dates.PATTERNS["us"], strict=True) -> DataFrame:
    """Performance sheet rows."""
    return _read(spark, path, schemas.PERFORMANCE, format, date_pattern, strict)


def read_weekly_targets(spark, path, format="parquet") -> DataFrame:
    return _read(spark, path, schemas.WEEKLY_TARGET, format, dates.PATTERNS["iso"], True)


def read_holidays(spark, path, format="parquet", date_pattern=dates.PATTERNS["iso"]) -> DataFrame:
    return _read(spark, path, schemas.HOLIDAYS, format, date_pattern, True)
