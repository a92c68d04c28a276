"""The SQL of text operators on the awkward documents gives the operators' rows."""

import duckdb
import pandas as pd
import pytest

from tests.llm import cases
from tremorlake.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql"))
    docs = cases.documents(5, 40)
    words = [t.split() for _, t, *_ in docs if t and 40 < len(t.split()) < 500]
    items = [(1, " ".join(words[-1][2:14])), (2, " ".join(words[-2][1:12])), (30, "Two WORDS"), (None, "one"), (4, ""), (5, None), (1, "a b c")]
    rows = spark.createDataFrame(docs, cases.SCHEMA).selectExpr("*", "CASE WHEN doc_id % 3 > 0 THEN 'src' || doc_id % 3 END AS source")
    rows.write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 40, 2)] + [(6, 1, None), (8, None, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = queries.queries()[name](spark, folder).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    keys = ["doc_id"] if "doc_id" in got else ["part", "filter_order", "step"]
    got, want = (f.sort_values(keys).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert len(got) == (40 if "doc_id" in got else 3 * 600)
