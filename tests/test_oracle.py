"""Every registered query against its SQL on DuckDB, value by value."""

import math

import duckdb
import pytest

from quernstone.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(value(None if x is None else x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, sf, duck):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
