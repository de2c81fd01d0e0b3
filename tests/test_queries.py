"""Queries against their SQL in DuckDB, on small tables."""

import duckdb
import pandas as pd
import pytest

from docaudit.plans import catalog

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    one = lambda v: "" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else f"{float(v):.5f}"
    return sorted(tuple(one(v) for v in r) for r in df[sorted(df)].itertuples(index=False))


@pytest.fixture
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got) == sorted(want)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
