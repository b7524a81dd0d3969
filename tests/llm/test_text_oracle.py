"""The registered queries with SQL against DuckDB."""

from pathlib import Path

import pytest

from shiftledger.llm import oracle, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.mark.parametrize("key", list(oracle.SQL))
def test_query_equals_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    result = con.execute(oracle.SQL[key])
    names = [column[0] for column in result.description]
    frame = queries.QUERIES[key](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(names)
    found = sorted(repr(tuple(row[name] for name in names)) for row in frame.collect())
    assert found == sorted(repr(row) for row in result.fetchall())
