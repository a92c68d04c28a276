"""Rows that are repeated or share a doc_id."""

import hashlib
from collections import Counter

from tests.llm import cases
from tremorlake.llm import op02_suffix, op09_recompress

PAIRS = [(i, t) for i, t, *_ in cases.documents()]


def table(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)


def counts(df):
    return Counter(tuple(r) for r in df.collect())


def test_repeated_rows_keep_what_one_keeps(spark, monkeypatch):
    words = PAIRS[-1][1].split() * 6
    pairs = [*PAIRS, (900, " ".join(words[:80])), *((901 + i, f"{i} " + " ".join(words[20 : 60 + i])) for i in range(5))]
    want = Counter((i, *x) for i, x in cases.removed_bytes(pairs).items() for _ in range(2))
    words_want = Counter((i, *x) for i, x in cases.removed_words(pairs).items() for _ in range(2))
    for hot in (64, 1):  # by suffix arrays and by windows' hashes
        monkeypatch.setattr("tremorlake.llm.repeats.HOT", hot)
        assert counts(op02_suffix.removal(table(spark, pairs * 2))) == want
        assert counts(op09_recompress.removal(table(spark, pairs * 2))) == words_want


def test_texts_that_share_a_doc_id_are_cut_each_by_itself(spark):
    a, b = ("".join(hashlib.sha256(f"{x}{i}".encode()).hexdigest() for i in range(5)) for x in "ab")
    got = {r.kept for r in op02_suffix.deduplicated(table(spark, [(1, a), (2, a), (2, b)])).collect()}
    assert got == {a, "", b}


def test_pipeline_stage_keeps_repeated_rows(spark, tmp_path):
    import corpus_pipeline as cp

    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 7, 1), (1, text, "en", "s", 7, 2), (2, text + " end", "en", "s", 7, 3), (None, text, "en", "s", 7, 4)], "doc_id int, text string, lang string, row string, n_chars long, __row long")
    got = cp.substrings(spark, docs, "")
    assert got.columns == docs.columns and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, text, len(text)), (1, text, len(text)), (2, " end", 4)]


def test_near_duplicates_tell_rows_apart(spark, monkeypatch):
    from tremorlake.llm import op05_divideskip

    # texts under doc_ids of their own, then the same under doc_ids that several share, and some rows twice
    plain = cases.near_duplicates(PAIRS)
    pairs = [(i // 3, t) for i, t in PAIRS]
    want = Counter((i // 3, plain[i][0], (plain[i][1] if plain[i][0] else i) // 3) for i, _ in PAIRS)
    assert counts(op05_divideskip.near_duplicates(table(spark, pairs))) == want
    monkeypatch.setattr(op05_divideskip, "HOT_COPIES", 2)
    monkeypatch.setattr(op05_divideskip, "SHORT", 2)
    monkeypatch.setattr(op05_divideskip, "LIST_ROWS", 3)
    twice = Counter({k: 2 * v for k, v in want.items()})
    assert counts(op05_divideskip.near_duplicates(table(spark, pairs * 2))) == twice
    monkeypatch.setattr(op05_divideskip, "VERY_LONG", 3)
    monkeypatch.setattr(op05_divideskip, "HOT_AT_ALL", 1)
    monkeypatch.setattr(op05_divideskip, "HOT_IN_BLOCK", 1)
    assert counts(op05_divideskip.near_duplicates(table(spark, pairs * 2))) == twice


def test_one_of_each_keeps_one_row(spark):
    from tremorlake.llm import op05_divideskip

    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"else{i}" for i in range(60))
    rows = [(1, text, "a", 7), (1, text, "b", 7), (1, other, "c", 7), (2, text + " end", "d", 7), (3, other, "e", 7), (4, None, "f", 7), (4, None, "g", 7), (4, "", "h", 7), (5, "", "i", 7), (None, text, "j", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row string, node long")
    got = op05_divideskip.one_of_each(docs)
    assert got.schema == docs.schema
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter([(1, text), (1, other), (4, ""), (5, "")])
    assert not op05_divideskip.one_of_each(docs.where("false")).collect()
