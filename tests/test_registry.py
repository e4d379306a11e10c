"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, sorted_rows, type_differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in df.collect()]
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [item[0] for item in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted_rows(df.columns, rows) == sorted_rows(columns, cursor.fetchall())
        assert not type_differences(df, cursor.description)
    else:
        assert rows
