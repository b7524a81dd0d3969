"""Stored tables whose rows are dealt to buckets by a hash of their keys.

Two tables with the same number of buckets over the keys of a join are joined, and each is grouped by them, without an
exchange: the rows that belong together lie in the same bucket already. The shuffle is paid once, when rows are
written, and for new rows only. Tables are versions with manifests as in ``sources/tables.py``, kept by part, and a
change rewrites the parts that it touches. The layout is a note of the manifest. To be read, a version is attached to
the session's catalog as a table whose partitions lie in the version's folders; Spark then knows its buckets.

Keys should be many and even: a person and day rather than a person, so that a busy person spreads over buckets.
A part holds one file per bucket, so the number of buckets is chosen for files of about a hundred megabytes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.sources import tables

PART = "stored_part"


@dataclass(frozen=True)
class Layout:
    """The keys whose hash picks a row's bucket, in order, and the number of buckets."""

    keys: tuple[str, ...]
    buckets: int

    @staticmethod
    def of(found: tables.Manifest) -> Layout:
        return Layout(tuple(json.loads(found.notes["keys"])), int(found.notes["buckets"]))

    def notes(self) -> dict[str, str]:
        return {"keys": json.dumps(self.keys), "buckets": str(self.buckets)}


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_parts(df: DataFrame, path: str, layout: Layout, part: Column) -> dict[str, str]:
    """Write rows into a new folder that no version lists yet, one file per part and bucket; the folder of each part."""
    spark = df.sparkSession
    name, draft = f"data-{uuid.uuid4().hex}", f"draft_{uuid.uuid4().hex}"
    dealt = df.withColumn(PART, part).repartition(layout.buckets, *layout.keys)
    writer = dealt.write.partitionBy(PART).bucketBy(layout.buckets, *layout.keys).sortBy(*layout.keys)
    try:
        writer.format("parquet").option("path", f"{path}/{name}").saveAsTable(draft)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {draft}")  # the catalog's entry; the files stay
    return tables.folders(spark, path, name, PART)


def write_table(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None, part: Column | None = None) -> tables.Manifest:
    """Write ``df`` as the whole content of the next version."""
    spark = df.sparkSession
    layout = Layout(tuple(keys), buckets or default_buckets(spark))
    written = write_parts(df, path, layout, F.lit(tables.WHOLE) if part is None else part)
    new = tables.Manifest(max(tables.versions(spark, path), default=0) + 1, written, layout.notes())
    tables.commit(spark, path, new)
    return new


def replace_parts(df: DataFrame, path: str, part: Column, touched: Iterable[str] = ()) -> tables.Manifest:
    """The next version, in the layout of the one before; parts as in ``tables.replace_parts``."""
    spark = df.sparkSession
    old = tables.manifest(spark, path)
    gone = set(touched)
    kept = {k: v for k, v in old.parts.items() if k not in gone}
    new = tables.Manifest(old.version + 1, {**kept, **write_parts(df, path, Layout.of(old), part)}, old.notes)
    tables.commit(spark, path, new)
    return new


def restate_days(rows: DataFrame, path: str, schema: T.StructType, col: str, days: Sequence[dt.date]) -> tables.Manifest | None:
    """Put ``rows``, all rows of some days, in the place of what the table, kept by month, holds of these days."""
    if not days:
        return None
    spark = rows.sparkSession
    months = {f"{day:%Y-%m}" for day in days}
    kept = read_table(spark, path, schema, parts=months).where(~F.col(col).isin(list(days)))
    return replace_parts(kept.unionByName(rows.select(*schema.names)), path, tables.month(col), months)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, at: int | None = None, parts: Iterable[str] | None = None
) -> DataFrame:
    """The rows of the newest version or the one ``at``, or of some of its parts; empty if there is none."""
    found = tables.manifest(spark, path, at)
    if not found or not found.parts:
        return spark.createDataFrame([], schema)
    rows = spark.table(_attached(spark, path, schema, found))
    return (rows if parts is None else rows.where(F.col(PART).isin(sorted(parts)))).drop(PART)


def beside(df: DataFrame) -> DataFrame:
    """A table of the same layout as the right side of a join: merged bucket by bucket, whatever its size."""
    return df.hint("merge")


def _attached(spark: SparkSession, path: str, schema: T.StructType, found: tables.Manifest) -> str:
    """The catalog's name of a version. It follows from the version's folders, so a version is attached once."""
    layout = Layout.of(found)
    content = json.dumps([path, schema.simpleString(), found.parts, found.notes], sort_keys=True)
    name = f"bucketed_{hashlib.sha256(content.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{key}`" for key in layout.keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({cols}, {PART} string) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout.buckets} BUCKETS LOCATION {_text(path)}"
        )
    folders = [f"PARTITION ({PART}={_text(k)}) LOCATION {_text(f'{path}/{v}')}" for k, v in sorted(found.parts.items())]
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(folders)}")
    return name


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
