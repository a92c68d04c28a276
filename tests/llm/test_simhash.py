"""SimHash by deletion variants against a plain form."""

import random
import re

import numpy as np
import xxhash

from tests.llm import cases
from tremorlake.llm import op12_simhash as op

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_FOLD))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """doc_id -> smallest doc_id reachable; prints: (doc_id, fingerprint)."""
    label = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3 and label[i] != label[j]:
                x, y = label[i], label[j]
                label = [min(x, y) if c in (x, y) else c for c in label]
    least = {}
    for (d, _), c in zip(prints, label):
        least[c] = min(d, least.get(c, d))
    return [(d, f"{f:016x}", least[c]) for (d, f), c in zip(prints, label)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_query_equals_the_plain_form(spark):
    rng, base = random.Random(3), [f"w{i}" for i in range(150)]
    rows = [(r[0], r[1]) for r in cases.documents(11, 60)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.004 * (i % 5) else f"x{i}" for w in base)) for i in range(60)]
    rows += [(500, None), (501, " \t"), (502, "A b"), (503, "a  B"), (3, "shares a doc_id"), (502, "A b"), (None, "no id")]
    want = sorted(plain_components([(d, plain_fingerprint(t)) for d, t in rows if d is not None]))
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, fp long, key string").repartition(3)
    assert rows_of(op.near_duplicates(docs)) == want
    assert len({c for *_, c in want}) < len(want) - 30  # there are links to find
    assert not rows_of(op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")))


def test_long_texts_are_hashed_in_runs(monkeypatch):
    texts = [t for _, t, *_ in cases.documents(4, 30)]
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    monkeypatch.setattr(op, "RUN", 7)
    assert op.shingle_bits(np.frombuffer(b"".join(data), np.uint8), offsets).tolist() == [plain_fingerprint(t) for t in texts]


def test_no_link_is_lost_with_crowded_halves(spark):
    """Random families of fingerprints a few bits apart, some of which share a half; every crowd limit gives the plain components."""
    rng = random.Random(8)
    prints = {0, 2**64 - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 12)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(x)
    half = rng.getrandbits(32)
    prints |= {half << 32 | rng.getrandbits(10) for _ in range(60)} | {rng.getrandbits(9) << 32 | half for _ in range(60)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    want = {p: c for (p, _, c) in plain_components([(k, p) for k, p in enumerate(prints)])}
    for crowd in (4096, 20, 2):
        label = list(range(len(prints)))
        place = {s[0]: k for k, s in enumerate(signed)}
        found = op.links(df, crowd).collect()
        for a, b in ((place[r.a], place[r.b]) for r in found):
            assert (prints[a] ^ prints[b]).bit_count() <= 3
            x, y = label[a], label[b]
            label = [min(x, y) if c in (x, y) else c for c in label]
        assert {k: c for k, c in enumerate(label)} == want


def test_groups_are_bounded():
    assert len(op._NIBBLES) == 56 and all(m.bit_count() == 20 for m in op._NIBBLES)
    for diff in (0b111, 0x80000001, 0x01010000, 1 << 31):  # any three bits leave five equal nibbles
        assert any(diff & m == 0 for m in op._NIBBLES)


def test_a_dense_group_gives_a_forest():
    fp = np.arange(300, dtype=np.uint64)
    a, b = op.group_links(np.zeros(300, int), np.zeros(300, np.uint64), fp)
    assert len(a) == 299 and (np.bitwise_count(fp[a] ^ fp[b]) <= 3).all()
