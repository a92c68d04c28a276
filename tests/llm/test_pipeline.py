"""The pipeline's stages against plain forms of the contracts, each on its own input."""

from tests.llm import cases


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t, *_ in cases.documents(3, 44)]
    words = [t.split() for _, t, *_ in rows if t and 40 < len(t.split()) < 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(44)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(words[-1][2:14])), (2, " ".join(words[-2][1:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)

    good = cp.quality(spark, docs, sf)
    assert good.columns == docs.columns

    one = cp.near_duplicates(spark, docs, sf)
    pairs = [(r[0], r[1]) for r in rows]
    want = {i for i, (_, c) in cases.near_duplicates(pairs).items() if i == c}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    cut = cp.substrings(spark, docs, sf)
    assert cut.columns == docs.columns and cut.count() == len(rows)

    clean = cp.decontaminate(spark, docs, sf)
    want = {i for i, c in cases.contamination(pairs, items).items() if not c[4]}
    assert {r.doc_id for r in clean.collect()} == want and len(want) < len(rows)

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    out = cp.run(spark, sf).toPandas()
    assert len(out) and out["length"].max() <= 4096
