"""What the quality stage keeps and where the packing stage puts its pieces."""

import random
import zlib

import pandas as pd
from tokenizers import Tokenizer

from tests.llm import cases
from tremorlake.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_keeps_clean_documents_and_rejects_bad_ones(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = "river stone window garden morning letter music winter bridge paper market harbour".split()
    prose = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(6))
    junk = lambda: "\n".join("$$$ CLICK >>> " + "#" * rng.randint(5, 30) + f" {rng.randint(0, 10**9)} !!!" for _ in range(6))
    rows = [(i, prose() if i % 3 else junk(), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in cp.quality(spark, docs, str(tmp_path)).collect()}
    unseen = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert kept & unseen == {i for i in unseen if i % 3} and len(unseen) > 30


def test_packed_pieces_are_the_documents(spark):
    import corpus_pipeline as cp

    docs = cases.documents(6, 60)
    rows = [(i, t, "en", "s", 0) for i, t, *_ in docs]
    got = cp.pack(spark, spark.createDataFrame(rows, SCHEMA), "").toPandas()
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, t, *_ in docs:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        mine = got[got.doc_id == i].sort_values("piece")
        want = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert mine["piece"].tolist() == list(range(len(want))) and mine["start"].tolist() == [4096 * k for k in range(len(want))]
        assert mine["length"].tolist() == [len(w) for w in want]
        assert mine["ids_crc32"].tolist() == [zlib.crc32(pd.Series(w).to_numpy("<u4").tobytes()) for w in want]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = (seq["offset"] + seq["length"]).tolist()
        assert seq["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 4096
