"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and bytes above ASCII. A benchmark item's windows are its runs
of WINDOW words, or the whole item where it is shorter. The fingerprint of a window of n words is the least hash of its
runs of K words; a text's fingerprints are those of its sliding windows. Equal windows have equal fingerprints, so any shared
span of n words shares one and no window is missed. Fingerprints of documents are joined with those of the benchmark; around
each common one the windows that contain it are extended to full length and compared by two independent 64-bit hashes.

The benchmark becomes a table of windows once, by Spark (``index``). If it has at most MOST_WINDOWS of them, which is counted, it
is broadcast as sorted arrays and the join is a lookup in the scan of the documents, without any shuffle. A larger one is
joined by shuffles: fingerprints first, then the few windows that hold a common one. Both give the same rows.

A null text has no words; texts of any length are whole. Every row of documents with a doc_id gives a row of its own, also rows
that are repeated or share a doc_id. Repeated items (same item_id) count once in n_items. Items without item_id count in
n_hit and contaminated; having no name, they are not in n_items and items_sha256. An empty benchmark hits nothing; no documents
give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RunHasher, blocks, mix, sliding_min, span_hashes, words_of, written
from .repeats import by_text

WINDOW = 10
K = 4
#: Windows of the benchmark up to which its table is broadcast (about 40 bytes each).
MOST_WINDOWS = 1_000_000

#: Lower-cased bytes inside words: digits, a-z and everything above ASCII (upper case is folded first).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
INDEX = "n int, one long, two long, print long, item string"
_PLACE = np.uint64(0x3FFFFFFF)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, codes, first = words_of(LOWER[data], offsets, WORD, RunHasher())
    return codes, first


def _ends_of(first: np.ndarray, n_words: int) -> np.ndarray:
    """For each word the end of its text."""
    return np.repeat(first[1:], np.diff(first))[:n_words]


def _least(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of K words, and for each run of n words the place of the least of them (the first of equals)."""
    grams = mix(span_hashes(codes, min(K, n)))
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), n - min(K, n) + 1)
    return grams, (least & _PLACE).astype(np.int64)


def _fingerprints(codes: np.ndarray, n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of K words and the places of those that some window of n words picks; none crosses texts."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, at = _least(codes, n)
    return grams, np.unique(at[np.arange(len(at)) + n <= ends[: len(at)]])


def _window_codes(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each n neighbouring words."""
    return span_hashes(codes, n), span_hashes(mix(codes ^ np.uint64(0x5851F42D4C957F2D)), n)


def _around(codes: np.ndarray, n: int, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and both hashes of every window of n words that contains one of the runs of K words at these places."""
    starts = np.unique((at[:, None] - np.arange(n - min(K, n) + 1)[None, :]).ravel())
    starts = starts[starts >= 0]
    starts = starts[starts + n <= ends[starts]]
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lo, hi = starts[0], starts[-1] + n
    return starts, *(h[starts - lo] for h in _window_codes(codes[lo:hi], n))


def index(benchmark: DataFrame) -> DataFrame:
    """INDEX: a row for each window of each item, with its fingerprint; item is null where the item has no id."""

    def make(batches):
        for (ids,), data, offsets in blocks(batches, ("item_id",)):
            codes, first = _words(data, offsets)
            n_words, ends = np.diff(first), _ends_of(first, len(codes))
            for n in range(1, WINDOW + 1):
                wanted = n_words == n if n < WINDOW else n_words >= n
                text = np.repeat(np.arange(len(ids)), n_words)[: max(0, len(codes) - n + 1)]
                at = np.flatnonzero(wanted[text] & (np.arange(len(text)) + n <= ends[: len(text)]))
                if len(at):
                    (one, two), (grams, least) = _window_codes(codes, n), _least(codes, n)
                    columns = (one[at], two[at], grams[least[at]])
                    yield pa.record_batch([pa.array(np.full(len(at), n, np.int32)), *(pa.array(c.view(np.int64)) for c in columns), ids.take(pa.array(text[at]))], ["n", "one", "two", "print", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(make, INDEX).distinct()


class Lookup:
    """The whole index as sorted arrays, by window length."""

    def __init__(self, table: pa.Table):
        n, one, two, prints = (table.column(c).to_numpy() for c in ("n", "one", "two", "print"))
        one, two, prints = (x.view(np.uint64) for x in (one, two, prints))
        names = table.column("item").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        self.names = names.dictionary.to_pylist()
        item = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.by_length = {}
        for k in np.unique(n).tolist():
            at = np.flatnonzero(n == k)
            at = at[np.lexsort([item[at], two[at], one[at]])]
            self.by_length[k] = (np.unique(prints[at]), one[at], two[at], item[at])

    def hits(self, codes: np.ndarray, first: np.ndarray):
        """Windows of the texts that are in the benchmark: (start, length, items) of each."""
        ends = _ends_of(first, len(codes))
        for n, (prints, b_one, b_two, b_item) in self.by_length.items():
            grams, at = _fingerprints(codes, n, ends)
            if not len(at):
                continue
            i = np.minimum(np.searchsorted(prints, grams[at]), len(prints) - 1)
            at = at[prints[i] == grams[at]]
            if not len(at):
                continue
            starts, one, two = _around(codes, n, at, ends)
            left, right = np.searchsorted(b_one, one, "left"), np.searchsorted(b_one, one, "right")
            some = np.flatnonzero(left < right)
            for s, i, j, t in zip(starts[some].tolist(), left[some].tolist(), right[some].tolist(), two[some]):
                items = b_item[i:j][b_two[i:j] == t]
                if len(items):
                    yield s, n, items.tolist()


def _by_lookup(texts: DataFrame, table: pa.Table) -> DataFrame:
    """SCHEMA by a broadcast of the whole index."""
    shared = texts.sparkSession.sparkContext.broadcast(Lookup(table))

    def scan(batches):
        bench = shared.value
        for (ids,), data, offsets in blocks(batches):
            codes, first = _words(data, offsets)
            hit, named = np.zeros(len(codes), bool), {}
            for s, n, items in bench.hits(codes, first):
                hit[s : s + n] = True
                named.setdefault(int(np.searchsorted(first, s, "right")) - 1, set()).update(items)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            names = [sorted(bench.names[k] for k in named.get(i, ()) if k >= 0) for i in range(len(n_hit))]
            yield pa.record_batch([ids, pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return texts.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def _by_join(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """SCHEMA by shuffled joins of fingerprints and then of windows. Rows of equal doc_id and text are looked at once."""
    lengths = [r[0] for r in bench.select("n").distinct().collect()]  # at most WINDOW numbers
    once = texts.dropDuplicates(["doc_id", "row"])

    def fingerprints(batches):
        for (ids, rows), data, offsets in blocks(batches, ("doc_id", "row")):
            codes, first = _words(data, offsets)
            for n in lengths:
                grams, at = _fingerprints(codes, n, _ends_of(first, len(codes)))
                text = pa.array(np.searchsorted(first, at, "right") - 1)
                yield pa.record_batch([pa.array(np.full(len(at), n, np.int32)), pa.array(grams[at].view(np.int64)), ids.take(text), rows.take(text)], ["n", "print", "doc_id", "row"])

    common = once.mapInArrow(fingerprints, "n int, print long, doc_id long, row long").join(bench.select("n", "print").distinct(), ["n", "print"], "left_semi")
    found = common.groupBy("doc_id", "row").agg(F.collect_set(F.struct("n", "print")).alias("prints"))

    def windows(batches):
        for (ids, rows, prints), data, offsets in blocks(batches, ("doc_id", "row", "prints")):
            codes, first = _words(data, offsets)
            ends, out = _ends_of(first, len(codes)), [[] for _ in range(len(ids))]
            owner = np.repeat(np.arange(len(ids)), np.asarray(prints.value_lengths().fill_null(0)))
            size, value = (prints.flatten().field(c).to_numpy() for c in (0, 1))
            for n in np.unique(size).tolist():
                grams, at = _fingerprints(codes, n, ends)
                text = np.searchsorted(first, at, "right") - 1
                mine = size == n
                known = set(zip(owner[mine].tolist(), value[mine].tolist()))
                at = at[[x in known for x in zip(text.tolist(), grams[at].view(np.int64).tolist())]] if len(at) else at
                starts, one, two = _around(codes, n, at, ends)
                text = np.searchsorted(first, starts, "right") - 1
                for t, s, a, b in zip(text.tolist(), (starts - first[text]).tolist(), one.view(np.int64).tolist(), two.view(np.int64).tolist()):
                    out[t].append({"n": n, "start": s, "one": a, "two": b})
            yield pa.record_batch([ids, rows, pa.array(np.diff(first), pa.int64()), pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("start", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])))], ["doc_id", "row", "n_words", "windows"])

    looked = written(once.join(found, ["doc_id", "row"], "left").select("doc_id", "row", "text", "prints").mapInArrow(windows, "doc_id long, row long, n_words long, windows array<struct<n:int,start:long,one:long,two:long>>"), "windows")
    hits = looked.select("doc_id", "row", F.inline("windows")).join(bench.select("n", "one", "two", "item"), ["n", "one", "two"])
    words = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))
    n_hit = hits.select("doc_id", "row", "start", "n").distinct().select("doc_id", "row", words.alias("word")).distinct().groupBy("doc_id", "row").agg(F.count("*").alias("n_hit"))
    items = hits.where("item IS NOT NULL").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = looked.select("doc_id", "row", "n_words").join(n_hit, ["doc_id", "row"], "left").join(items, ["doc_id", "row"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    each = texts.select("doc_id", "row").join(result, ["doc_id", "row"])
    return each.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the words hit by the benchmark's windows and the items they come from (SCHEMA)."""
    bench, texts = written(index(benchmark), "index"), by_text(docs)
    return _by_lookup(texts, bench.toArrow()) if bench.count() <= MOST_WINDOWS else _by_join(texts, bench)
