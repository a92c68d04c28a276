"""Benchmarks with items without an id, broadcast and joined, and documents that share a doc_id."""

from collections import Counter

from tests.llm import cases
from tremorlake.llm import op03_winnow

PAIRS = [(i, t) for i, t, *_ in cases.documents()]


def table(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)


def counts(df):
    return Counter(tuple(r) for r in df.collect())


def test_items_without_an_id(spark, monkeypatch):
    words = [t.split() for _, t in PAIRS if t and 40 < len(t.split()) < 500]
    items = [(1, " ".join(words[0][5:20])), (2, " ".join(words[1][5:20])), (None, " ".join(words[-1][3:18])), (4, " ".join(words[3][8:30])), (5, " ".join(words[4][8:30]))]
    # what the plain form gives under a name of its own, without that name
    plain, named = cases.contamination(PAIRS, items), cases.contamination(PAIRS, [x for x in items if x[0]])
    want = Counter((i, x[0], x[1], *named[i][2:4], x[4]) for i, x in plain.items())
    assert any(x[4] and not named[i][4] for i, x in plain.items())
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert counts(op03_winnow.contamination(table(spark, PAIRS), bench)) == want
    # the same by shuffled joins as by a broadcast index
    monkeypatch.setattr(op03_winnow, "MOST_WINDOWS", 0)
    assert counts(op03_winnow.contamination(table(spark, PAIRS), bench)) == want
    # rows that share a doc_id give a row each, repeated ones or not, by both
    twice = PAIRS + [(i, "other") for i, _ in PAIRS] + PAIRS[:15]
    joined = counts(op03_winnow.contamination(table(spark, twice), bench))
    monkeypatch.setattr(op03_winnow, "MOST_WINDOWS", 10**6)
    assert joined == counts(op03_winnow.contamination(table(spark, twice), bench)) and joined.total() == len(twice)


def test_pipeline_drops_what_any_row_of_a_document_leaks(spark, tmp_path):
    import corpus_pipeline as cp

    text = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, " ".join(text.split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = spark.createDataFrame([(1, text), (1, "clean"), (2, "clean")], "doc_id long, text string")
    assert [r.doc_id for r in cp.decontaminate(spark, shared, str(tmp_path)).collect()] == [2]
