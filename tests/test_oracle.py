"""Every query against its SQL counterpart on the smallest shared tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagemart.oracle import ORACLES
from pagemart.registry import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "part lineitem pages"

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = []
    for row in rows:
        cells = [row[i] for i in order]
        lines.append(tuple(None if isinstance(c, float) and math.isnan(c) else c for c in cells))
    return sorted(lines, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, str(DATA))
    got = plain(frame.columns, frame.collect())
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == plain(columns, result.fetchall())
    assert got, "a query without rows checks nothing"


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() == 20
