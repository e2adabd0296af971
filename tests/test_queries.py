"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import glob
import hashlib
import os

import duckdb
import pandas as pd
import pytest

from quillfold import catalog

DATA = os.environ.get("QUILLFOLD_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if x is None or pd.isna(x):
        return None
    return float(x) if isinstance(x, (int, float)) else str(x)


def canon(pdf: pd.DataFrame) -> tuple:
    cols = sorted(pdf.columns)
    rows = sorted(repr([plain(x) for x in row]) for row in pdf[cols].astype(object).itertuples(index=False))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest(), rows[:3]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetchdf()
    assert canon(got) == canon(want)
