"""Every registered query against its SQL, on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.run import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# The library's own queries; those of the training-data operators are tested in tests/llm.
SQL = registry.SQL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["url"] for r in rows)
