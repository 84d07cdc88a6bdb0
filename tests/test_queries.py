"""Every query with checking SQL gives the rows that DuckDB gives for that SQL."""

import decimal
import math

import duckdb
import pytest

from loamwork.plans import catalogue
from loamwork.plans.fixtures import TABLES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0
