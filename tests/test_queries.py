"""Every registered query against its SQL on the smallest shared tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="shared tables not present")


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    got = table(df.columns, df.collect())
    if name not in SQL:
        assert got[1]
        return
    result = con.execute(SQL[name])
    want = table([c[0] for c in result.description], result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
