"""Stored tables with versions.

A table is a folder of data folders, each written once and never changed, and one small manifest per version. The
manifest names the folder of every part (a month, or the whole) and is committed last, by a rename: a version is
exactly what its manifest lists, and data of a lost run are invisible. A change writes new folders for the parts that
it touches; all others keep their files. Reading a version lists that version's folders only, and no job is needed to
find the newest one. A table has one writer at a time.

Manifests hold one entry per part, so their size is bounded by the number of months, not by the rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions.dates import ColumnOrDate, as_col

WHOLE = "whole"
UNDATED = "undated"
ORPHAN_HOURS = 24


@dataclass(frozen=True)
class Manifest:
    """A version: the folder of each part below the table's, and notes of the writer."""

    version: int
    parts: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def month(col: ColumnOrDate) -> Column:
    """The part of a row in a table kept by month."""
    return F.coalesce(F.date_format(as_col(col), "yyyy-MM"), F.lit(UNDATED))


def parts_of(rows: DataFrame, part: Column) -> set[str]:
    """The parts that rows fall into; the driver gets one value per part."""
    return {r[0] for r in rows.select(part).distinct().collect()}


# Files, by the file system that the path belongs to


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found) and fs.getFileStatus(found).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of the files of a folder."""
    fs, found = _path(spark, path)
    return fs.getContentSummary(found).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


# Versions


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """The manifest file of each version; of several commits of one version the last."""
    names = [n for n in _names(spark, f"{path}/_versions") if n.endswith(".json")]
    return {int(name.split("-")[0]): name for name in names}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    return sorted(_manifests(spark, path))


def manifest(
    spark: SparkSession, path: str, at: int | None = None, before: int | None = None
) -> Manifest | None:
    """The newest version, the one ``at``, or the newest one older than ``before``; None if there is none."""
    files = _manifests(spark, path)
    fits = [v for v in files if (at is None or v == at) and (before is None or v < before)]
    if not fits:
        return None
    fs, name = _path(spark, f"{path}/_versions/{files[max(fits)]}")
    stream = fs.open(name)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(text))


def commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Make a version visible. A version that is there already is replaced."""
    known = _manifests(spark, path).get(new.version)
    attempt = int(known.split("-")[1].split(".")[0]) + 1 if known else 0
    fs, draft = _path(spark, f"{path}/_versions/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(json.dumps(new.__dict__, sort_keys=True).encode())
    stream.close()
    target = _path(spark, f"{path}/_versions/{new.version:012d}-{attempt:06d}.json")[1]
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"another writer has committed version {new.version} of {path}")


def write_parts(df: DataFrame, path: str, part: Column | None = None) -> dict[str, str]:
    """Write rows into a new folder that no version lists yet; the folder of each part.

    The rebalance hint brings a part's rows together, so that each task writes few files, and splits a large part.
    """
    name = f"data-{uuid.uuid4().hex}"
    if part is None:
        df.write.parquet(f"{path}/{name}")
        return {WHOLE: name}
    df.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{name}")
    return folders(df.sparkSession, path, name, "part")


def folders(spark: SparkSession, path: str, name: str, part: str) -> dict[str, str]:
    """The folder of each part of a data folder that was partitioned by the column ``part``."""
    written = [n for n in _names(spark, f"{path}/{name}") if n.startswith(f"{part}=")]
    return {n.removeprefix(f"{part}="): f"{name}/{n}" for n in written}


def write_table(
    df: DataFrame, path: str, version: int | None = None, part: Column | None = None, notes: dict[str, str] | None = None
) -> Manifest:
    """Write ``df`` as the whole content of a version, the next one if none is named."""
    spark = df.sparkSession
    if version is None:
        version = max(versions(spark, path), default=0) + 1
    new = Manifest(version, write_parts(df, path, part), notes or {})
    commit(spark, path, new)
    return new


def replace_parts(df: DataFrame, path: str, part: Column, touched: Iterable[str] = ()) -> Manifest:
    """The next version, in which the rows of ``df`` are the content of their parts and of those ``touched``.

    A touched part without rows is gone. The folders of all other parts stay as they are.
    """
    new = prepare_parts(df, path, part, touched)
    commit(df.sparkSession, path, new)
    return new


def prepare_parts(df: DataFrame, path: str, part: Column, touched: Iterable[str] = ()) -> Manifest:
    """The version that ``replace_parts`` would commit, written but not visible yet; its writer may read it."""
    old = manifest(df.sparkSession, path) or Manifest(0)
    gone = set(touched)
    kept = {k: v for k, v in old.parts.items() if k not in gone}
    return Manifest(old.version + 1, {**kept, **write_parts(df, path, part)}, old.notes)


def read_manifest(
    spark: SparkSession, path: str, schema: T.StructType, found: Manifest | None, wanted: Callable[[str], bool] | None = None
) -> DataFrame:
    """The rows of a version, or of its ``wanted`` parts."""
    folders = sorted(v for k, v in found.parts.items() if wanted is None or wanted(k)) if found else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in folders])


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    at: int | None = None,
    before: int | None = None,
    wanted: Callable[[str], bool] | None = None,
) -> DataFrame:
    """The rows of the newest version, or of the one that ``at`` or ``before`` picks; empty if there is none."""
    return read_manifest(spark, path, schema, manifest(spark, path, at, before), wanted)


def retire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions (at least one), and the data that only the others listed.

    Data that no version lists are left alone while they are young, as a running job may be about to commit them.
    """
    found = {v: manifest(spark, path, at=v) for v in versions(spark, path)}
    newest = sorted(found)[-max(keep, 1) :]
    used = {folder for v in newest for folder in found[v].parts.values()}
    retired = {folder for v in found if v not in newest for folder in found[v].parts.values()}
    # Manifests go first: data without a manifest are harmless, a manifest without its data is not.
    for name in _names(spark, f"{path}/_versions"):
        if name.endswith(".json") and int(name.split("-")[0]) not in newest:
            _delete(spark, f"{path}/_versions/{name}")
    for folder in retired - used:
        _delete(spark, f"{path}/{folder}")
    listed = {folder.split("/")[0] for folder in used}
    for name in _names(spark, path):
        if name.startswith("data-") and name not in listed:
            fs, folder = _path(spark, f"{path}/{name}")
            hours = (time.time() - fs.getFileStatus(folder).getModificationTime() / 1000) / 3600
            emptied = name in {f.split("/")[0] for f in retired}
            if emptied or hours > ORPHAN_HOURS:
                fs.delete(folder, True)
