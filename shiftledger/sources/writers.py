"""Writers. Snapshots are versions of a stored table, so a job never overwrites what it reads.

A load batch of facts is one partition value and is written with dynamic partition overwrite: running a batch again
replaces its own rows only, which makes a rerun after a lost job safe. Batches must not share days; days that
change are restated in tables kept by day (``plans/daily.py``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.sources import tables


def write_snapshot(df: DataFrame, path: str, snapshot: int, keep: int | None = None) -> None:
    """Write ``df`` as the whole content of the table at ``snapshot``; with ``keep``, older ones are retired."""
    tables.write_table(df, path, snapshot)
    if keep is not None:
        tables.retire(df.sparkSession, path, keep)


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, at: int | None = None
) -> DataFrame:
    """The newest snapshot, the newest one older than ``before``, or the one ``at``; empty when there is none."""
    return tables.read_table(spark, path, schema, at, before)


def append_facts(df: DataFrame, path: str, batch: int, date_col: str = "date") -> None:
    """Append the fact rows of one load batch, partitioned by year, month and batch.

    The rebalance hint brings the rows of a month together before the write, so that each task writes
    few files, and splits a month that is larger than the advised partition size.
    """
    (
        df.withColumns({"year": F.year(date_col), "month": F.month(date_col), "batch": F.lit(batch)})
        .hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month", "batch")
        .parquet(path)
    )


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All fact rows, with the year and month partition columns for pruning."""
    return _read_or_empty(spark, path, _with_ints(schema, "year", "month", "batch"))


def export_targets(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write targets for the dashboard into a new folder; an existing folder is an error."""
    writer = df.write.mode("errorifexists")
    if format == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(format).save(path)


def _with_ints(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, T.IntegerType(), True) for name in names]])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table under ``path``, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
