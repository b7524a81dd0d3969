"""Stored tables: versions, retention, lost runs and changes by month."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest

from shiftledger import schemas
from shiftledger.operators import changes
from shiftledger.plans import stored
from shiftledger.sources import tables, writers

D = dt.date
H = Decimal
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def targets(spark, *rows):
    return spark.createDataFrame([(i, "n", d, H(h), t) for i, d, h, t in rows], schemas.TARGET_UPDATE)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, D(2024, m, d), "4", T0) for i in (1, 2, 3) for m in range(1, 7) for d in (1, 15)]
    stored.write_targets(targets(spark, *rows, (9, None, "4", T0)), str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_a_change_leaves_the_files_of_other_months(spark, table, rows):
    before, current = files(table), stored.read_targets(spark, table)
    expected = rows(changes.upsert(current, targets(spark, (1, D(2024, 3, 1), "7", T1), (8, D(2025, 1, 1), "7", T1))))
    new = stored.upsert(spark, table, targets(spark, (1, D(2024, 3, 1), "7", T1), (8, D(2025, 1, 1), "7", T1)))
    assert rows(stored.read_targets(spark, table)) == expected
    assert new.version == 2 and {k: v for k, v in files(table).items() if k in before} == before
    old = tables.manifest(spark, table, at=1).parts
    assert {k for k in new.parts if old.get(k) != new.parts[k]} == {"2024-03", "2025-01"}
    assert stored.read_targets(spark, table, at=1).count() == 37
    # A range reads its months only.
    paths = [f for f in stored.read_targets(spark, table, D(2024, 2, 3), D(2024, 3, 9)).inputFiles()]
    assert {f.split("part=")[1].split("/")[0] for f in paths} == {"2024-02", "2024-03"}


def test_update_and_delete(spark, table, rows):
    change = targets(spark, (1, D(2024, 3, 1), "7", T1), (1, D(2024, 3, 2), "7", T1), (1, D(2030, 3, 2), "7", T1))
    new = stored.update(spark, table, change, ["target_hour"])
    assert rows(stored.read_targets(spark, table).where("target_hour = 7"), "practitioner_id", "target_date") == [(1, D(2024, 3, 1))]
    assert stored.update(spark, table, targets(spark, (1, D(2030, 3, 2), "7", T1)), ["target_hour"]) is None
    people = targets(spark, (1, D(2024, 1, 1), "0", T0), (2, D(2024, 1, 1), "0", T0), (3, D(2024, 1, 1), "0", T0))
    new = stored.delete_range(spark, table, people, D(2024, 5, 1), D(2024, 6, 10))
    assert "2024-05" not in new.parts, "an emptied month is gone"
    assert rows(stored.read_targets(spark, table).where("target_date >= '2024-05-01'"), "target_date") == [(D(2024, 6, 15),)] * 3
    stored.delete_keys(spark, table, targets(spark, (1, D(2024, 1, 1), "0", T0)))
    assert stored.read_targets(spark, table).where("target_date = '2024-01-01'").count() == 2
    assert stored.read_targets(spark, table).where("target_date is null").count() == 1


def test_a_lost_change_leaves_the_old_version(spark, table, rows, monkeypatch):
    before = rows(stored.read_targets(spark, table))

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "commit", lost)
        with pytest.raises(RuntimeError):
            stored.upsert(spark, table, targets(spark, (1, D(2024, 3, 1), "7", T1)))
    assert rows(stored.read_targets(spark, table)) == before and tables.versions(spark, table) == [1]
    stored.upsert(spark, table, targets(spark, (1, D(2024, 3, 1), "7", T1)))
    assert stored.read_targets(spark, table).where("target_hour = 7").count() == 1


def test_old_versions_are_retired(spark, table, rows, monkeypatch):
    for k in range(3):
        stored.upsert(spark, table, targets(spark, (1, D(2024, 3, 1 + k), "7", T1)))
    whole = rows(stored.read_targets(spark, table))
    n = len(files(table))
    tables.write_parts(targets(spark, (1, D(2024, 3, 1), "1", T1)), table)  # not committed yet
    tables.retire(spark, table, keep=1)
    assert tables.versions(spark, table) == [4] and rows(stored.read_targets(spark, table)) == whole
    assert len(files(table)) < n, "the month's old files are gone, a young folder without a version is not"
    folders = [f for f in Path(table).glob("data-*")]
    assert len(folders) == 3
    monkeypatch.setattr(tables, "ORPHAN_HOURS", -1)
    tables.retire(spark, table, keep=1)
    assert len(list(Path(table).glob("data-*"))) == 2 and rows(stored.read_targets(spark, table)) == whole


def test_a_snapshot_lists_its_own_folder(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    for k in (1, 2, 3):
        writers.write_snapshot(spark.createDataFrame([(k, "North", None)], schemas.DIM_LOCATION), path, k)
    found = writers.read_snapshot(spark, path, schemas.DIM_LOCATION)
    assert {f.split("/")[-2] for f in found.inputFiles()} == set(tables.manifest(spark, path).parts.values())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Aggregate" not in plan and "ubquery" not in plan
    # A snapshot written again replaces itself; a version that another writer commits at once is an error.
    writers.write_snapshot(spark.createDataFrame([(7, "North", None)], schemas.DIM_LOCATION), path, 3)
    assert rows(writers.read_snapshot(spark, path, schemas.DIM_LOCATION), "location_id") == [(7,)]
    assert tables.read_table(spark, str(tmp_path / "none"), schemas.DIM_LOCATION).count() == 0
