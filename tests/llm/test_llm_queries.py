"""Queries with a SQL twin against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from strandline.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, expected = registry.queries()[name](spark, SF), c.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    got = sorted(repr(tuple(r[k] for k in order)) for r in df.collect())
    at = [expected.columns.index(k) for k in order]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in expected.fetchall())
