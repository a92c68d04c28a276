"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the most frequent pieces of the whole corpus with their token counts, of at most
HEAD_PIECES entries, which the driver broadcasts. Tier two is a cache in each Python worker; it encodes what the
table doesn't hold. Pieces of texts are never shuffled: each task sends only its HEAD_PER_TASK most frequent pieces,
already summed, when the table is made. The counts are exact whatever the table holds.

Null and empty texts have 0 tokens; very long texts are cut into pieces like others. An empty table gives an empty
result. Special strings inside texts are what the library makes of them by default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, clean_docs
from .tokens import CACHE_PIECES, as_pieces, encode_pieces, library, piece_starts

HEAD_PIECES = 16_384
HEAD_PER_TASK = 1_024

_CACHE: dict[str, tuple] = {}


def _task_heads(batches):
    counts: dict[bytes, int] = {}
    for _, data, offsets in blocks(batches):
        pieces = as_pieces(data, piece_starts(data, offsets))
        n = np.bincount(np.asarray(pieces.indices), minlength=len(pieces.dictionary))
        top = np.argsort(-n, kind="stable")[: 4 * HEAD_PER_TASK]
        words = pieces.dictionary.take(pa.array(top)).to_pylist()
        for w, k in zip(words, n[top].tolist()):
            counts[w] = counts.get(w, 0) + k
        if len(counts) > 64 * HEAD_PER_TASK:  # light ones go; this changes the table's use, never a count
            counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 16 * HEAD_PER_TASK])
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:HEAD_PER_TASK]
    yield pa.record_batch([pa.array([w for w, _ in head], pa.binary()), pa.array([k for _, k in head], pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, tokenizer: str) -> dict[bytes, int]:
    """Token counts of the corpus's most frequent pieces: HEAD_PIECES at most, so that it may be broadcast."""
    heads = clean_docs(docs).mapInArrow(_task_heads, "piece binary, n long")
    top = heads.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(HEAD_PIECES).select("piece").toPandas()
    pieces = [bytes(p) for p in top["piece"]]
    return dict(zip(pieces, encode_pieces(library(tokenizer), pieces)[1].tolist()))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, by the tokenizer in that file."""
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def count(batches):
        if tokenizer not in _CACHE:
            _CACHE[tokenizer] = (library(tokenizer), {})
        tk, cache = _CACHE[tokenizer]
        table = head.value
        for (ids,), data, offsets in blocks(batches):
            starts = piece_starts(data, offsets)
            pieces = as_pieces(data, starts)
            distinct = pieces.dictionary.to_pylist()
            lens = np.fromiter((table.get(p) or cache.get(p, -1) for p in distinct), np.int64, len(distinct))
            miss = np.flatnonzero(lens < 0)
            lens[miss] = encode_pieces(tk, [distinct[i] for i in miss])[1]
            kept = miss[: max(0, CACHE_PIECES - len(cache))]
            cache.update(zip((distinct[i] for i in kept), lens[kept].tolist()))
            total = np.concatenate([[0], np.cumsum(lens[np.asarray(pieces.indices)])])
            n = np.diff(total[np.searchsorted(starts, offsets)])
            yield pa.record_batch([ids, pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return clean_docs(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
