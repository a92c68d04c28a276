"""Importance resampling of documents towards a target distribution, by tries of words.

Features of a text are its runs of 1 to ``longest`` words. Each task holds a trie of the runs it has met: a child is reached from its parent by one more
word, and a node holds how often its run occurred and the CRC-32 state of the run's bytes, from which those of its children go on. A node's bucket is
its state modulo ``buckets``. Tasks send their bucket totals (``buckets`` rows at most), which are summed for the documents and for the target; a
bucket's gain tells how much likelier it is in the target. Then documents are scored by walking the trie's paths once more, with gains attached to nodes.

A document's weight is the floored mean of its features' gains, its score the weight plus Gumbel noise that its doc_id and the seed decide. Of
documents with at least ``least_words`` words the ``per_cent`` highest scores are drawn and ranked, from range partitions, so that no task sorts all.

A trie of more than MOST_NODES nodes sends its counts and starts anew; totals are sums, so this changes nothing. Nulls and empty texts have no features and
the weight 0. Rows without doc_id are left out of the result and of the counts; rows that share a doc_id have the same noise; repeated rows are each a document, and ties
beyond doc_id are ordered by the number of features. Target rows without text have no words. Very long texts are blocks of their own. An empty table gives
an empty result, an empty target gains of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.sequences import ordinal

from .common import LOWER, blocks, clean_docs, runs_of, written
from .tokens import as_pieces

#: Nodes of a task's trie from which it is emptied.
MOST_NODES = 1 << 20
#: Lower-cased bytes inside words: digits, a-z and everything above ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class WordTrie:
    """Runs of up to ``longest`` words. Node 0 is the root; ``children`` leads from (parent, word) on, words being numbered as first met."""

    def __init__(self, longest: int):
        self.longest = longest
        self.words: dict[bytes, int] = {}
        self.children: dict[tuple[int, int], int] = {}
        self.state = np.zeros(1, np.uint32)
        self.count = np.zeros(1, np.int64)

    def _grow(self, states: list[int]) -> None:
        self.state = np.concatenate([self.state, np.array(states, np.uint32)])
        self.count = np.concatenate([self.count, np.zeros(len(states), np.int64)])

    def _step(self, parent: np.ndarray, word: np.ndarray, text: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The node below each parent by each word (places in the block's list of words); new ones get their states."""
        pair, back = np.unique(parent * len(text) + word, return_inverse=True)
        nodes, states = np.empty(len(pair), np.int64), []
        for k, (p, w) in enumerate(zip((pair // len(text)).tolist(), (pair % len(text)).tolist())):
            key = (p, int(ids[w]))
            node = self.children.get(key)
            if node is None:
                node = self.children[key] = len(self.state) + len(states)
                states.append(zlib.crc32(b" " + text[w], int(self.state[p])) if p else zlib.crc32(text[w]))
            nodes[k] = node
        self._grow(states)
        return nodes[back]

    def walk(self, data: np.ndarray, offsets: np.ndarray):
        """For each length of run: the texts of the runs and their nodes; adds what isn't in the trie."""
        low = LOWER[data]
        starts, ends = runs_of(_WORD[low], offsets)
        pieces = as_pieces(low, starts, ends)
        text = pieces.dictionary.to_pylist()
        ids = np.fromiter((self.words.setdefault(w, len(self.words)) for w in text), np.int64, len(text))
        word = np.asarray(pieces.indices).astype(np.int64)
        doc = np.searchsorted(offsets, starts, "right") - 1
        node = np.zeros(len(word), np.int64)
        for k in range(self.longest):
            inside = np.flatnonzero(doc[: len(doc) - k] == doc[k:]) if k < len(doc) else np.zeros(0, np.int64)
            if not len(inside):
                return
            node[inside] = self._step(node[inside], word[inside + k], text, ids)
            yield doc[inside], node[inside]

    def totals(self, buckets: int) -> np.ndarray:
        return np.bincount(self.state[1:] % buckets, self.count[1:], minlength=buckets).astype(np.int64)


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. texts: (doc_id, text)."""

    def count(batches):
        trie, total = WordTrie(longest), np.zeros(buckets, np.int64)
        for _, data, offsets in blocks(batches):
            for _, node in trie.walk(data, offsets):
                trie.count += np.bincount(node, minlength=len(trie.count))
            if len(trie.state) > MOST_NODES:
                total += trie.totals(buckets)
                trie = WordTrie(longest)
        total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log of each bucket's smoothed share in the target over that in the source."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Floored thousandths of a Gumbel variable."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def score(batches):
        gain, trie, of_node = shared.value, WordTrie(longest), np.zeros(0, np.int64)
        for (ids,), data, offsets in blocks(batches):
            n, total, n_words = (np.zeros(len(ids), np.int64) for _ in range(3))
            for k, (doc, node) in enumerate(trie.walk(data, offsets)):
                of_node = np.concatenate([of_node, gain[trie.state[len(of_node) :] % len(gain)]])
                found = np.bincount(doc, minlength=len(ids))
                n += found
                n_words += found if k == 0 else 0
                change = np.flatnonzero(np.diff(doc, prepend=-1))
                total[doc[change]] += np.add.reduceat(of_node[node], change)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noises = np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, len(ids))
            yield pa.record_batch([ids, *(pa.array(c) for c in (n, n_words, weight, weight + noises))], ["doc_id", "n_features", "n_words", "weight", "score"])
            if len(trie.state) > MOST_NODES:
                trie, of_node = WordTrie(longest), np.zeros(0, np.int64)

    return clean_docs(docs).mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def drawn(rows: DataFrame, least_words: int, per_cent: int) -> DataFrame:
    """Adds rank to rows of scored: from 1 for the highest scores among documents of enough words, null for what isn't drawn."""
    able = F.col("n_words") >= least_words
    # scores are whole thousandths of logarithms of 64-bit counts and 32-bit noise, so fewer than 150 000 differ
    counts = sorted(((r.score, r.n) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, at, cut = per_cent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if at >= draw:
            break
        at, cut = at + n, score
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= cut)
    placed = ordinal(rows.where(high).withColumn("_down", -F.col("score")), [], ["_down", "doc_id", "n_features"], "_place")
    rank = F.when(F.col("_place") < draw, F.col("_place") + 1).cast("long")
    return placed.select(*rows.columns, rank.alias("rank")).unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, per_cent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document."""
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gain = gains(bucket_totals(clean_docs(docs), longest, buckets), bucket_totals(wanted, longest, buckets))
    rows = written(scored(docs, gain, longest, seed), "scores")
    return drawn(rows, least_words, per_cent).select("doc_id", "n_features", "weight", "score", "rank")
