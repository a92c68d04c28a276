"""What op2 takes of a worker's memory: hashes of slices of a block, comparisons of a few thousand stretches."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tremorlake.llm import op02_suffix, repeats
from tremorlake.llm.common import BLOCK_BYTES


def _block(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 123, n).astype(np.uint8)
    data[n // 2 : n // 2 + n // 4] = data[: n // 4]
    return data, np.concatenate([[0], np.sort(rng.integers(0, n + 1, 40)), [n, n]])


def _peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 99, 100, 700, 5000])
@pytest.mark.parametrize("slice_bytes", [1, 7, 300, 1000])
def test_slices_give_the_stretches_of_the_whole(monkeypatch, n, slice_bytes):
    data, offsets = _block(n, n)
    whole = op02_suffix._stretches(data, offsets)
    monkeypatch.setattr(op02_suffix, "SLICE_BYTES", slice_bytes)
    for a, b in zip(whole, op02_suffix._stretches(data, offsets)):
        np.testing.assert_array_equal(a, b)


def test_a_block_is_hashed_in_a_few_times_its_bytes():
    data, offsets = _block(BLOCK_BYTES, 1)
    assert _peak(lambda: op02_suffix._stretches(data, offsets)) < 20 * BLOCK_BYTES / 1e6


def test_hot_windows_are_hashed_alone():
    data, offsets = _block(BLOCK_BYTES, 2)
    _, same, text, lo, hi = op02_suffix._stretches(data, offsets)
    some, ids = slice(0, 50), np.arange(len(offsets) - 1)
    hot = np.arange(50) % 5 == 0
    assert _peak(lambda: list(op02_suffix._details(data, offsets, ids, ids, text[some], lo[some], hi[some], hot, same[some].view(np.int64)))) < 10 * BLOCK_BYTES / 1e6


def test_stretches_are_compared_a_few_thousand_at_once(spark, monkeypatch):
    """Each document has a string of its own twice, with other bytes around it: all go to the comparison."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        shared = "".join(map(chr, rng.integers(97, 123, 110)))
        rows.append((i, "".join(map(chr, rng.integers(65, 91, 30))) + shared + "".join(map(chr, rng.integers(65, 91, 30))) + shared))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    most = spark.sparkContext.accumulator(0)
    asked = spark.sparkContext.accumulator(0)

    def compare(table: pa.Table):
        asked.add(table.num_rows)
        most.add(int(table.num_rows > 2 * repeats.COMPARED_ROWS + 2000))
        return op02_suffix._compare(table)

    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = repeats.repeated_stretches(docs, op02_suffix._stretches, op02_suffix._details, compare, other_docs_only=False).select("doc_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert found == 6000 and asked.value > 10_000 and most.value == 0
