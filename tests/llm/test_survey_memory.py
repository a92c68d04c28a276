"""What op5's survey takes of a worker's memory: sets of a few texts at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tremorlake.llm import op05_divideskip as op

WORDS = np.array(["".join(map(chr, w)) for w in np.random.default_rng(5).integers(97, 123, (400, 5))])


def _texts(n: int, words: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join(WORDS[rng.integers(0, 400, rng.integers(0, words + 1))]) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 50, 700])
def test_sets_of_a_few_texts_are_those_of_all(monkeypatch, size):
    raw = [t.encode() for t in ["", *_texts(60, 12, 1), "", "a", "a b", " ", ""]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    values, bounds = op.shingle_sets(data, offsets)
    monkeypatch.setattr(op, "SETS_BYTES", size)
    more, cuts = op.shingle_sets(data, offsets)
    np.testing.assert_array_equal(values, more)
    np.testing.assert_array_equal(bounds, cuts)


def test_no_texts_have_no_sets():
    values, bounds = op.shingle_sets(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(values) == 0 and bounds.tolist() == [0]


def test_a_block_is_surveyed_in_a_few_times_its_bytes():
    texts = _texts(4000, 600, 2)
    ids = pa.array(range(4000), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "row", "text"])
    size = min(op.SURVEY_BYTES, sum(map(len, texts)))
    assert size > op.SURVEY_BYTES / 2
    tracemalloc.start()
    try:
        list(op._survey([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * size
