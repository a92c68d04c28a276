"""Every stage on empty tables, null ids and texts, and rows that repeat or share a doc_id."""

from collections import Counter

import pytest

from tests.llm import cases

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, held string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(44)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, "nothing of it"), (1, "to be sure of it no text has this window of ten words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows():
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "x") for i, t, *_ in cases.documents(3, 30)]
    return out + out[:6] + [(None, "no id at all", "en", "s", 1, 0, "x"), (3, "another text of document three", "en", "s", 1, 0, "x")]


def test_stages_take_awkward_rows(spark, folder):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(rows(), COLUMNS)
    with_id = Counter(r[0] for r in rows() if r[0] is not None)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        found = Counter(r.doc_id for r in got.collect())
        assert None not in found and all(found[i] <= with_id[i] for i in found), name
    packed = cp.pack(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == with_id


def test_stages_take_empty_tables(spark, folder):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, folder)
        assert not got.collect(), name
    docs.write.parquet(f"{folder}/documents.parquet")
    assert not cp.run(spark, folder).collect()
