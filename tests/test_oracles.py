"""Every query with SQL gives DuckDB's rows on a small scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if k in entry.plans.queries()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    cell = lambda x: "NULL" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)].astype(object)
    return sorted(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(SQL))
def test_query(spark, duck, key):
    assert rows(entry.queries()[key](spark, SF).toPandas()) == rows(duck.execute(SQL[key]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
