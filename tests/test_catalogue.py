"""Each query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from literal import basic, findings, measured, sites

from siltstone.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "pages documents events lineitem orders customer conversations benchmark labels supplier nation".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return f"{float(value):.9g}" if hasattr(value, "quantize") else repr(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


SETS = [catalogue, basic, measured, findings, sites]


@pytest.mark.parametrize("name, of", [(name, of) for of in SETS for name in sorted(of.QUERIES)])
def test_against_sql(spark, duck, name, of):
    got, want = of.QUERIES[name](spark, FOLDER), duck.sql(of.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    right = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert left == right
