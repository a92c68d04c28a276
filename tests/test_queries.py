"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from tremorlake.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
        return "null"
    if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool):
        return repr(round(float(x), 9) + 0.0)
    return str(x)


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(x) for x in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).toPandas())
