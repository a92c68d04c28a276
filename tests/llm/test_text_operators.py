"""Text operators against plain forms of the contracts, with nulls, empty and long texts, ties and repeats."""

import zlib

import numpy as np
import pytest

from tests.llm import cases
from tremorlake.llm import op01_repair, op02_suffix, op03_winnow, op05_divideskip, op07_telephony, op08_sumsquares, op09_recompress, op10_twotier
from tremorlake.llm.tokens import library, tokenizer_path

ROWS = cases.documents()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def ids_of(name, text, end):
    return library(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs, empty):
    got = rows_of(op10_twotier.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")))
    for i, text in PAIRS:
        n = len(ids_of("byte_bpe_50k.json", text, 0)) - 1
        assert got[i] == (len((text or "").encode()), n, n > 512), text
    assert not rows_of(op10_twotier.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")))


def test_token_files(spark, docs, empty, tmp_path):
    op01_repair.write_ids(docs, f"{tmp_path}/a", tokenizer_path("byte_bpe_50k.json"))
    got, start = rows_of(op01_repair.read_ids(spark, f"{tmp_path}/a")), 0
    for i, text in PAIRS:
        ids = ids_of("byte_bpe_50k.json", text, 2)
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)
    flat = [x for _, text in PAIRS for x in ids_of("byte_bpe_50k.json", text, 2)]
    for a, b in ((0, 1), (7, 700), (len(flat) - 5, len(flat)), (3, 3)):
        parts = sorted(op01_repair.read_range(spark, f"{tmp_path}/a", a, b).collect())
        assert [x for p in parts for x in p.ids] == flat[a:b] and (a == b or parts[0].at == a)
    op01_repair.write_ids(empty, f"{tmp_path}/b", tokenizer_path("byte_bpe_50k.json"))
    assert not rows_of(op01_repair.read_ids(spark, f"{tmp_path}/b"))


def test_grammar_round_trip_and_ranges():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 20_000):
        ids = rng.choice([3, 4, 70_000, 9], n, p=[0.6, 0.2, 0.1, 0.1]).astype(np.uint32)
        counts = np.array([n]) if n < 50 else np.array([n // 2, n - n // 2])
        g = op01_repair.build_grammar(ids, counts)
        assert (op01_repair.expand(g["symbols"], g["n_terminals"], g["rules"], g["round_sizes"]) == ids).all()
        row = {"symbols": op01_repair._planes(g["symbols"]), "n_terminals": g["n_terminals"], "rules": g["rules"].tobytes(), "round_sizes": g["round_sizes"], "expansions": g["expansions"].tobytes()}
        for a, b in ((0, 1), (n // 3, n // 3 + 1), (n // 2, n), (0, n)):
            assert (op01_repair.decode_range(row, a, b) == ids[a:b]).all()
    assert len(g["symbols"]) < n / 2
    # no pair is left that occurs LEAST_COUNT times within the documents
    seq, left, at = g["symbols"].tolist(), {}, 0
    ends, total = set(np.cumsum(counts).tolist()), 0
    lengths = np.concatenate([np.ones(g["n_terminals"], int), g["expansions"].astype(int)])
    for x, y in zip(seq, seq[1:]):
        total += lengths[x]
        if total not in ends:
            left[x, y] = left.get((x, y), 0) + 1
    assert all(k < op01_repair.LEAST_COUNT for (x, y), k in left.items() if x != y)


def test_suffix_dedup(docs, empty):
    assert rows_of(op02_suffix.removal(docs)) == cases.removed_bytes(PAIRS)
    assert not rows_of(op02_suffix.removal(empty))


def test_suffix_dedup_of_common_stretches(spark):
    rows = cases.documents(7, 24)
    shared = "an unusual sentence that every one of these many documents holds somewhere in the middle of its text, letter by letter; "
    rows += [(1000 + i, f"{i * 7919} before " + shared * (1 + i % 2) + f"after {i * 104729}", None, 1, 1, "") for i in range(150)]
    pairs = [(r[0], r[1]) for r in rows]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    assert rows_of(op02_suffix.removal(docs)) == cases.removed_bytes(pairs)
    assert rows_of(op09_recompress.removal(docs)) == cases.removed_words(pairs)


def test_maximal_repeats():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(6)]
    lengths, first, places = op02_suffix.maximal_repeats(texts, 3)
    starts = np.cumsum([0] + [len(t) for t in texts])
    got = {}
    for k, n in enumerate(lengths.tolist()):
        at = places[first[k] : first[k + 1]]
        doc = np.searchsorted(starts, at, "right") - 1
        word = {texts[d][p - starts[d] : p - starts[d] + n] for d, p in zip(doc.tolist(), at.tolist())}
        assert len(word) == 1
        got[word.pop()] = sorted(zip(doc.tolist(), (at - starts[doc]).tolist()))
    every: dict = {}
    for d, t in enumerate(texts):
        for n in range(3, len(t) + 1):
            for p in range(len(t) - n + 1):
                every.setdefault(t[p : p + n], []).append((d, p))
    want = {}
    for w, at in every.items():
        before = {texts[d][p - 1] if p else (d, "start") for d, p in at}
        after = {texts[d][p + len(w)] if p + len(w) < len(texts[d]) else (d, "end") for d, p in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want[w] = sorted(at)
    assert got == want


def test_contamination(spark, docs, empty):
    text = [t for _, t in PAIRS if t and len(t.split()) > 30]
    items = [(1, " ".join(text[0].split()[5:19])), (2, "one"), (3, None), (4, "Two WORDS"), (5, " ".join(text[3].upper().split()[2:12])), (5, " ".join(text[3].split()[2:12])), (6, "nowhere to be found at all in any of these texts here")]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    assert rows_of(op03_winnow.contamination(docs, bench)) == cases.contamination(PAIRS, items)
    assert not rows_of(op03_winnow.contamination(empty, bench))
    assert not any(r[1] for r in rows_of(op03_winnow.contamination(docs, bench.where("false"))).values())


def test_contamination_by_joins(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(op03_winnow, "MOST_WINDOWS", 0)
    text = [t for _, t in PAIRS if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[3:15])) for k, t in enumerate(text[:7])] + [(8, "one"), (9, "Two WORDS"), (10, "two words"), (11, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(op03_winnow.contamination(docs, bench)) == cases.contamination(PAIRS, items)
    assert not rows_of(op03_winnow.contamination(empty, bench))


def test_near_duplicates(docs, empty):
    assert rows_of(op05_divideskip.near_duplicates(docs)) == cases.near_duplicates(PAIRS)
    assert not rows_of(op05_divideskip.near_duplicates(empty))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op05_divideskip, "BLOCK", 4)
    monkeypatch.setattr(op05_divideskip, "SHORT", 5)
    import random

    rng, base = random.Random(5), [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.015 * (i % 7) else f"x{i}-{k}" for k, w in enumerate(base))) for i in range(40)]
    assert rows_of(op05_divideskip.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == cases.near_duplicates(rows)


def test_t_occurrence():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(300, k, replace=False)) for k in (3, 10, 40, 120, 200, 290, 299)]
    count = np.bincount(np.concatenate(lists), minlength=300)
    for least in range(1, 8):
        docs, n = op05_divideskip.t_occurrence(lists, least)
        assert docs.tolist() == np.flatnonzero(count >= least).tolist() and n.tolist() == count[count >= least].tolist()


def test_telephony(docs, empty, spark, tmp_path):
    import hashlib

    got = rows_of(op07_telephony.telephony(docs))
    for i, text in PAIRS:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        media = op07_telephony.wav(payload)
        assert got[i][:6] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert not rows_of(op07_telephony.telephony(empty))
    for codec in ("mu", "a", "adpcm"):
        op07_telephony.store_pcm(op07_telephony.encode_clips(docs), f"{tmp_path}/{codec}", codec)
        assert spark.read.parquet(f"{tmp_path}/{codec}").count() == len(ROWS)


def test_telephony_codecs():
    mu, a = op07_telephony.MU_LAW.astype(int), op07_telephony.A_LAW.astype(int)
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    got = op07_telephony.decode_adpcm(blocks)
    for b, out in zip(blocks, got):
        value, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want = [value]
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(op07_telephony.STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(op07_telephony.INDEX_MOVE[code])))
                want.append(value)
        assert out.tolist() == want
    flat = np.full(9, 500, np.int16)
    assert (op07_telephony.resample_double(flat, np.array([0, 4])) == 500).all()


def test_packing(docs, empty):
    name, cap = "word_bpe_49k.json", 4096
    rows = op08_sumsquares.pack_documents(docs, tokenizer_path(name)).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, text in PAIRS:
        ids = ids_of(name, text, 1)
        total += len(ids)
        want = [(k, k * cap, len(ids[k * cap : (k + 1) * cap]), crc(ids[k * cap : (k + 1) * cap])) for k in range(-(-len(ids) // cap))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    for part in by_bin.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    assert len(by_bin) <= -(-total // cap) + 1
    assert not op08_sumsquares.pack_documents(empty, tokenizer_path(name)).collect()


def test_sum_of_squares_chooses_the_least_sum():
    sizes, cap = np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10
    bins, offsets = op08_sumsquares.sum_of_squares(sizes, cap)
    gaps = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def total(g):
            return sum(n * n for n in np.bincount([x for x in g.values() if x > 0], minlength=1).tolist())
        options = [total({**gaps, k: g - s}) for k, g in gaps.items() if g >= s] + [total({**gaps, -1: cap - s})]
        assert cap - o == gaps.get(b, cap)
        gaps[b] = gaps.get(b, cap) - s
        assert total(gaps) == min(options)


def test_recompression_dedup(docs, empty):
    assert rows_of(op09_recompress.removal(docs)) == cases.removed_words(PAIRS)
    assert not rows_of(op09_recompress.removal(empty))


def test_kept_texts(docs):
    import hashlib

    kept = rows_of(op09_recompress.deduplicated(docs))
    want = cases.removed_words(PAIRS)
    assert all(hashlib.sha256(kept[i][0].encode()).hexdigest() == want[i][2] for i in want)
    assert len(rows_of(op02_suffix.deduplicated(docs))) == len(PAIRS)
