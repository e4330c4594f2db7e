"""Every registered query against its SQL, on the smallest driver data."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point
from workloads.catalog import QUERIES
from workloads.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "embeddings", "events", "documents", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data is not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value) + 0.0:.6f}"
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = entry_point.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = sql.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = result.fetchall()
    # A ratio may be a whole number on one side and a float on the other.
    number = [any(isinstance(r[i], (float, Decimal)) for r in rows) for i in order]
    want = sorted(tuple(plain(float(r[i]) if f and r[i] is not None else r[i]) for i, f in zip(order, number)) for r in rows)
    assert got == want and got


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
