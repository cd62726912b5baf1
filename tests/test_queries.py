"""Every core query with a SQL twin against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", registry.UNREGISTERED)
def test_fixed_rows_equal_sql(spark, duck, name):
    query, sql = registry.unregistered()[name]
    df, expected = query(spark, SF), duck.sql(sql)
    assert name not in registry.queries() and rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", "f05_theme_roots f06_css_imports f08_css_urls f13_page_source f14_change_rows f15_revision_rows f16_file_links f30_sniff f36_journal g01_references".split())
def test_extractors_read_every_row(spark, duck, name):
    df = registry.queries()[f"{name}_table"](spark, SF)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    want = duck.sql(f"SELECT DISTINCT {key} FROM {'pages' if key == 'page_id' else 'documents'}").fetchall()
    assert sorted(r[0] for r in df.select(key).distinct().collect()) == sorted(x[0] for x in want)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
