"""Packing documents into sequences by the sum-of-squares rule.

A document's ids are cut into pieces only where it is longer than a sequence. Pieces are dealt to groups of about
GROUP_PIECES at random; in a group, each piece goes, longest first, where the sum of the squared counts of open
bins over all residual gaps becomes smallest. Groups are independent, so the work spreads over the cluster, and each
wastes a few open bins at most.

Null and empty texts have just the end id. Empty tables give an empty result. Rows with the same doc_id are packed
apart, each as a document of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, clean_docs, written
from .tokens import encoder

GROUP_PIECES = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # the sum changes by 2(N[g-s] - N[g]) + 2 when a bin of gap g takes s; a full bin counts no more
        change = count[: capacity + 1 - s] - count[s:]
        change[0] = -count[s]
        change = np.where(count[s:] > 0, 2 * change + 2, np.iinfo(np.int64).max)
        change[0] -= count[s] > 0
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = int(np.argmin(change)) + s
        if len(change) and change[g - s] <= fresh:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, cut only where they exceed the capacity."""

    def cut(batches):
        encode = encoder(tokenizer, words=True)
        for (doc,), data, offsets in blocks(batches):
            ids, counts = encode(data, offsets, end_id)
            n = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, counts[of] - start)
            view = memoryview(ids.tobytes())
            at = (np.cumsum(counts) - counts)[of] + start
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            yield pa.record_batch([doc.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return clean_docs(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 .. capacity."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["_group"].to_numpy(np.int64) * (1 << 32) + bins, offset=offsets).drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).cast("int")).groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Every piece of every document with the sequence it is placed in and its offset there."""
    return pack(written(pieces_of(docs, tokenizer, end_id, capacity), "pieces"), capacity)
