"""A passage that many texts share ties no texts that can't link, and loses no link."""

from __future__ import annotations

import random

from tremorlake.llm import op05_divideskip

from . import cases


def rows_with_passages() -> list[tuple[int, str]]:
    """Texts of 60 words, of which 44 are one of three passages that hundreds share, near copies of some of them, and texts with more or less of a passage."""
    rng, out = random.Random(8), []
    passages = [[f"p{k}-{i}" for i in range(44)] for k in range(3)]
    for i in range(450):
        own = [f"w{i}-{j}" for j in range(16)]
        out.append(own + passages[i % 3])
        if i % 9 == 0:
            out.append([*own[:-1], f"z{i}", *passages[i % 3]])
        if i % 10 == 0:
            out.append(own[: rng.randint(1, 9)] + passages[i % 3])
    return [(k, " ".join(words)) for k, words in enumerate(out)]


def labels(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in op05_divideskip.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_long_lists_make_no_large_groups(spark, monkeypatch):
    rows, links, found = rows_with_passages(), op05_divideskip._links, []

    def counted(texts, classes, ties):
        groups = op05_divideskip.components(ties).where("id >= 0").groupBy("component").count()
        found.append(max([r["count"] for r in groups.collect()], default=0))
        return links(texts, classes, ties)

    monkeypatch.setattr(op05_divideskip, "_links", counted)
    assert labels(spark, rows) == cases.near_duplicates(rows)
    assert found[0] < 100


def test_shingles_that_no_block_shows_to_be_frequent(spark, monkeypatch):
    # nothing is known to be frequent at first, lists are long from three classes on and come in parts, and some aren't made
    rows = rows_with_passages()[:180]
    want = cases.near_duplicates(rows)
    monkeypatch.setattr(op05_divideskip, "HOT_AT_ALL", 1000)
    monkeypatch.setattr(op05_divideskip, "SHORT", 3)
    assert labels(spark, rows) == want
    monkeypatch.setattr(op05_divideskip, "LIST_ROWS", 40)
    assert labels(spark, rows) == want
    monkeypatch.setattr(op05_divideskip, "VERY_LONG", 30)
    assert labels(spark, rows) == want
    monkeypatch.setattr(op05_divideskip, "ROUNDS", 1)
    monkeypatch.setattr(op05_divideskip, "WIDE_GROUP", 2)
    monkeypatch.setattr(op05_divideskip, "BLOCK", 4)
    assert labels(spark, rows) == want
