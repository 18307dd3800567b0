"""Every query of the operators runs on the smallest tables, over all their rows, and gives its SQL's rows."""

import os

import duckdb
import pytest

from thermolith.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = {"op3_html_extract": "pages", "op10_topk": None, "op13_blocknorm": "embeddings"}
SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def cells(table):
    """Rows of an Arrow table by sorted names; whole numbers are compared as such, nulls among them or not."""
    names = sorted(table.column_names)
    return sorted(tuple("NULL" if r[n] is None or r[n] != r[n] else repr(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_query(spark, key):
    got = queries.queries()[key](spark, SF).toArrow()
    if table := TABLES.get(key, "documents"):
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if key in SQL:
        duck = duckdb.connect()
        for t in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert cells(got) == cells(duck.execute(SQL[key]).to_arrow_table())
