"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW_HERE = ("op2_", "op10_")  # held against brute force in their own tests


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(SLOW_HERE)])
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and os.path.isdir("/root/testdata/sf0.001")
