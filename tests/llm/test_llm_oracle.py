"""Queries that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    by = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
    assert by(got) == by(want)
