"""Every registered query against the same query in SQL on DuckDB, at the smallest scale.

``ORACLE_SF_DIR`` names another scale-factor folder.
"""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from shiftledger.catalog import all_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")

# Spark type names and what DuckDB calls them.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "date": "DATE",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", list(all_queries()))
def test_query_equals_sql(spark, duck, key):
    query = all_queries()[key]
    frame = query(spark, SF_DIR)
    found = frame.collect()
    assert query.sql, "every query has an oracle"
    result = duck.execute(query.sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]).replace(" ", "") for column in result.description}
    assert sorted(frame.columns) == sorted(names)
    assert {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in frame.schema} == types
    spark_rows = sorted(repr(tuple(row[name] for name in names)) for row in found)
    assert spark_rows == sorted(repr(row) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(all_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())
