"""Person-days in partitions whose number follows the size of the line items."""

import re
from pathlib import Path

import pytest

from shiftledger import catalog
from shiftledger.plans import colocated
from shiftledger.sources import buckets, mapping, tables
from shiftledger.sources.mapping import Landing

QUERIES = catalog.all_queries()
from shiftledger.catalog import stored  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [Landing.per_day, Landing.target, Landing.target_update])
def test_pieces_follow_the_line_items(spark, rows, monkeypatch, build):
    few = build(Landing(spark, SF_DIR))
    held = Path(f"{SF_DIR}/lineitem.parquet").stat().st_size
    monkeypatch.setattr(mapping, "PIECE_BYTES", held // 20)
    many = build(Landing(spark, SF_DIR))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = [re.search(r"(\d+)\), REPARTITION_BY_NUM", plan_of(df)).group(1) for df in (few, many)]
    assert dealt[0] == str(least) and dealt[1] in ("20", "21")
    # Nothing is summed before the shuffle, where it would fill a task's memory.
    below = plan_of(many).split("Exchange hashpartitioning")[1]
    assert "HashAggregate" not in below
    assert rows(few) == rows(many)


@pytest.fixture
def own_tables(spark, tmp_path):
    """Line items of two months by a dozen people at two places."""
    sources = {
        "region": spark.sql("SELECT 0 r_regionkey, 'NORTH' r_name"),
        "nation": spark.sql("SELECT id n_nationkey, concat('P', id) n_name, 0 n_regionkey FROM (SELECT cast(id AS int) id FROM range(2))"),
        "supplier": spark.sql("SELECT id s_suppkey, concat('Staff ', id) s_name, cast(id % 2 AS int) s_nationkey, id * 300D s_acctbal FROM range(12)"),
        "lineitem": spark.sql(
            "SELECT id l_orderkey, id l_partkey, id % 12 l_suppkey, 1 l_linenumber, 2D l_quantity, 10.5D l_extendedprice, 0D l_discount,"
            " 0D l_tax, 'N' l_returnflag, 'O' l_linestatus, timestamp_ntz'1997-03-20' + make_dt_interval(int(id % 25)) l_shipdate FROM range(400)"
        ),
    }
    for name, df in sources.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_buckets_follow_the_line_items(spark, rows, monkeypatch, own_tables):
    def layouts():
        t = Landing(spark, own_tables)
        paths = stored.days_and_targets(t)
        found = [buckets.Layout.of(tables.manifest(spark, path)).buckets for path in paths]
        return found, rows(colocated.daily_with_target(spark, *paths)), t

    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    few, before, t = layouts()
    assert few == [least, least]
    monkeypatch.setattr(mapping, "BUCKET_BYTES", tables.size(spark, f"{own_tables}/lineitem.parquet") // 9)
    many, after, t = layouts()
    assert many[0] == many[1] and many[0] in (9, 10)
    assert before == after == rows(QUERIES["left_join_target_daily"](spark, own_tables)) and before
    assert rows(QUERIES["bucketed_late_rows"](spark, own_tables)) == before


def test_late_rows_are_dealt_before_they_are_summed(spark, monkeypatch, own_tables):
    seen = []
    monkeypatch.setattr(colocated, "write_person_days", lambda df, path, n=None: seen.append((plan_of(colocated.person_days(df)), n)))
    monkeypatch.setattr(colocated, "write_day_targets", lambda df, path, n=None: None)
    monkeypatch.setattr(colocated, "restate_person_days", lambda df, path, days: None)
    monkeypatch.setattr(colocated, "daily_with_target", lambda spark, *paths: spark.range(0))
    QUERIES["bucketed_late_rows"](spark, own_tables)
    (plan, n), = seen
    assert n and "HashAggregate" not in plan.split("Exchange hashpartitioning")[1]
