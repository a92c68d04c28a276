"""Importance resampling against a plain form."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tests.llm import cases
from tremorlake.llm import op13_resample as op

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text, longest):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(_FOLD))
    return [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def plain(docs, target, longest, buckets, least_words, per_cent):
    bucket = lambda f: zlib.crc32(f) % buckets
    source = Counter(bucket(f) for _, t in docs for f in features(t, longest)[0])
    wanted = Counter(bucket(f) for t in target for f in features(t, longest)[0])
    s_all, t_all = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all)))
    rows = []
    for d, t in docs:
        fs, n_words = features(t, longest)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0], r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: per_cent * len(able) // 100])}
    return sorted((*r[:4], rank.get(id(r)) or 0) for r in rows)


@pytest.mark.parametrize(("longest", "buckets", "most_nodes"), [(1, 10_000, 1 << 20), (3, 97, 1 << 20), (2, 10_000, 5)])
def test_equals_the_plain_form(spark, monkeypatch, longest, buckets, most_nodes):
    monkeypatch.setattr(op, "MOST_NODES", most_nodes)
    monkeypatch.setattr("tremorlake.llm.common.BLOCK_BYTES", 4000)
    docs = [(r[0], r[1]) for r in cases.documents(21, 70)]
    docs += docs[20:24] + [(3, "another text of a doc_id"), (None, "no id " * 30)]
    target = [docs[40][1], docs[41][1].upper(), None, "", "a b c"]
    df = spark.createDataFrame([(*d, 7, "s") for d in docs], "doc_id long, text string, score long, bucket string").repartition(3)
    goal = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = op.resampled(df, goal, longest=longest, buckets=buckets, least_words=20, per_cent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((*r[:4], r[4] or 0) for r in got.collect()) == plain([d for d in docs if d[0] is not None], target, longest, buckets, 20, 30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "x " * 30), (2, None)], "doc_id long, text string")
    assert not op.resampled(none, none).collect()
    assert not op.resampled(none, some).collect()
    assert [r["rank"] for r in op.resampled(some, none, per_cent=100).orderBy("doc_id").collect()] == [1, None]


def test_states_go_on_from_parents():
    import numpy as np

    text = b"ab cd ab cd ef"
    trie = op.WordTrie(3)
    got = [sorted({int(s) for s in trie.state[node]}) for _, node in trie.walk(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
    assert got == [sorted({zlib.crc32(f) for f in features(text.decode(), k)[0] if f.count(b" ") == k - 1}) for k in (1, 2, 3)]
