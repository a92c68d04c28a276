"""The resampled PCM that op7 stores: there, lossless, and what features are computed from."""

from __future__ import annotations

import zlib

import numpy as np

from tremorlake.llm import op07_telephony as op

TEXTS = [(1, "a short text"), (2, None), (3, ""), (4, "é中" * 500), (5, "x" * 64), (5, "another of the same doc_id")]


def test_any_pcm_comes_back():
    rng = np.random.default_rng(4)
    for sizes in ([1], [3, 1, 64], [500]):
        starts = np.cumsum(sizes) - sizes
        wide = rng.integers(-32768, 32768, 2 * sum(sizes)).astype(np.int16)
        got, begin = op.pcm_samples(op.pcm_bytes(wide, starts))
        np.testing.assert_array_equal(got, wide)
        assert begin.tolist() == starts.tolist()
    assert len(op.pcm_samples([])[0]) == 0


def test_query_stores_pcm_and_reads_it(spark, monkeypatch):
    stored = []

    def written(df, name, options=None):
        stored.append(keep(df, name, options))
        return stored[-1]

    keep = op.written
    monkeypatch.setattr(op, "written", written)
    got = op.telephony(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    rows = stored[0].select("media", "pcm").collect()
    assert len(rows) == len(got) == len(TEXTS)
    want = {}
    for media, pcm in rows:
        payload = np.frombuffer(op.payload_of(bytes(media)), np.uint8)
        wide = op.resample_double(op.MU_LAW[payload], np.zeros(1, np.int64))
        read, _ = op.pcm_samples([bytes(pcm)])
        np.testing.assert_array_equal(read, wide)
        want[zlib.crc32(payload[-64:].tobytes())] = f"pcm16k:n={2 * len(payload)},crc={zlib.crc32(wide.astype('<i2').tobytes())}"
    for row in got:
        assert want[row["tail_crc32"]] in row["feature"]


def test_features_come_from_the_stored_pcm(spark):
    clips = op.with_pcm(op.encode_clips(spark.createDataFrame(TEXTS[:1], "doc_id long, text string")))
    (row,) = clips.collect()
    other = np.arange(128, dtype=np.int16)
    changed = spark.createDataFrame([(row["doc_id"], row["n_bytes"], row["media"], bytearray(op.pcm_bytes(other, np.zeros(1, np.int64))[0]))], clips.schema)
    assert f"crc={zlib.crc32(other.tobytes())}" in op.clip_features(changed).first()["feature"]
