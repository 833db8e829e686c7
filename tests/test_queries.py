"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from millrace.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(columns, rows):
    """Rows with columns by name, in an order that does not depend on the engine."""
    by_name = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        return "NaN" if isinstance(value, float) and math.isnan(value) else value

    return sorted(([cell(row[i]) for i in by_name] for row in rows), key=repr)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    result = contract.queries()[name](spark, SF)
    expected = database.sql(contract.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    rows = [tuple(row) for row in result.collect()]
    assert rows
    assert comparable(result.columns, rows) == comparable(expected.columns, expected.fetchall())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["event_type", "n"]
    assert sum(row.n for row in result.collect()) == 1000
