"""Every registered query with SQL against DuckDB over the same tables; the others run and keep their schema."""

import datetime
import decimal
import math

import duckdb
import pytest

from wordloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
SLOW = {"h01_random_forest", "h02_forest_regressor", "h04_linear_svc", "h05_polynomial_svc", "d12_louvain", "c52_tensor_centrality", "d06_giant_component"}


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
