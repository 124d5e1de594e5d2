"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def rows_of(table):
    frame = table.to_pandas()
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if v != v else v for v in row]) for row in frame.itertuples(index=False, name=None))


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(sql is not None for sql in contract.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    mine = contract.queries()[name](spark, SF_DIR).toArrow()
    other = db.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(other.column_names)
    assert rows_of(mine) == rows_of(other)
