"""Suffix-array dedup: bytes that a string of SIZE bytes covers which also starts earlier.

``maximal_repeats`` builds an enhanced suffix array (ranks by prefix doubling, longest common prefixes from the same
ranks), scans the tree of common-prefix intervals with a stack, and keeps the intervals whose occurrences have
different bytes before them: maximal repeat groups with all their occurrences. In a group every occurrence but the
first is a repeat.

A corpus is not one array: windows meet by anchors (see repeats.py), the anchor of a 100-byte window being the least
hash of its 32-byte strings. Each group of stretches that share an anchor and differ somewhere is small and gets its
own part of a suffix array. Null and empty texts have no bytes; texts shorter than SIZE lose nothing; of equal texts the
one of smallest doc_id stays. A row that is repeated, text and doc_id, is one document: its rows keep the same bytes. Other rows
that share a doc_id are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, blocks, mix, ragged, runs_of, sliding_min, span_hashes
from .repeats import anchor_stretches, covered, repeated_stretches, repeats_of_windows, window_rows, with_stretches

SIZE = 100
ANCHOR = 32
_PLACE = np.uint64(0x3FFFFFFF)
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
#: A stretch has as many windows at most as a window has places for an anchor.
REACH = SIZE - ANCHOR + SIZE
#: Bytes of text that repeats are taken out of at once.
TAKEN_BYTES = 1 << 20


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of an array of small positive integers in order of their first ``depth`` items at least, and the ranks
    by first 1, 2, 4, ... items. Place behind the end ranks lowest."""
    n = len(text)
    ranks, width = {1: text.astype(np.int64)}, 1
    order = np.argsort(text, kind="stable")
    while width < depth:
        r = ranks[width]
        key = r * (int(r.max()) + 2 if n else 1)
        key[: n - width] += r[width:] + 1 if n > width else 0
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1])) if n else 0
        width *= 2
        ranks[width] = rank
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: dict[int, np.ndarray], room: np.ndarray) -> np.ndarray:
    """Length of what each suffix in the order shares with the one before it; room is how long each suffix may be."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, np.int64)
    for width in sorted(ranks, reverse=True):
        x, y = a + length, b + length
        ok = (x < n) & (y < n)
        same = np.zeros(n - 1, bool)
        same[ok] = ranks[width][x[ok]] == ranks[width][y[ok]]
        length += np.where(same, width, 0)
    out[1:] = np.minimum(length, np.minimum(room[a], room[b]))
    return out


def prefix_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the suffix array with common prefixes of ``least`` or more, by a stack."""
    found, stack = [], []
    at = np.flatnonzero(lcp >= least)
    before = -1
    for i, length in zip(at.tolist(), lcp[at].tolist()):
        if i != before + 1:
            while stack:
                depth, left = stack.pop()
                found.append((depth, left, before))
        left = i - 1
        while stack and stack[-1][0] > length:
            depth, left = stack.pop()
            found.append((depth, left, i - 1))
        if not stack or stack[-1][0] < length:
            stack.append((length, left))
        before = i
    while stack:
        depth, left = stack.pop()
        found.append((depth, left, before))
    return found


def maximal_repeats(texts: list[bytes] | tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeat groups of least bytes or more: length of each, index into places of each one's first (one more at
    the end), and the places of all occurrences, counted over the joined texts."""
    if isinstance(texts, tuple):
        data, offsets = texts
    else:
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    n, n_texts = len(data), len(offsets) - 1
    where = np.arange(n) + np.repeat(np.arange(n_texts), np.diff(offsets))
    joined = np.zeros(n + n_texts, np.int64)  # a 0 behind each text
    joined[where] = data.astype(np.int64) + 1
    ends = offsets[1:] + np.arange(n_texts)
    room = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(joined))
    depth = max(least, int(np.diff(offsets).max()) if n_texts else 1)
    order, ranks = suffix_array(joined, min(depth, 1 << 20))
    lcp = common_prefixes(order, ranks, room)
    left = np.empty(len(order), np.int64)  # the byte before, another value for each text that begins there
    prev = order - 1
    left[prev >= 0] = joined[prev[prev >= 0]]
    begins = (prev < 0) | (left == 0)
    left[begins] = -1 - order[begins]
    changes = np.cumsum(np.append(0, left[1:] != left[:-1])) if len(left) else left
    groups = [g for g in prefix_intervals(lcp, least) if changes[g[2]] != changes[g[1]]]
    lengths, first, last = (np.array(x, np.int64) for x in zip(*groups)) if groups else (np.zeros(0, np.int64),) * 3
    sizes = last - first + 1
    places = order[ragged(first, sizes)]
    places = places - np.searchsorted(ends, places)  # without the zeros
    return lengths, np.concatenate([[0], np.cumsum(sizes)]), places


def _slice_stretches(data: np.ndarray, ends: np.ndarray, begin: int):
    """Anchor hash, content hash, first and last window of the stretches of a slice of text; ends: of each window's text, in the slice."""
    codes = BYTE_CODE[data]
    grams = mix(span_hashes(codes, ANCHOR))
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), SIZE - ANCHOR + 1)
    at = (least & _PLACE).astype(np.int64)
    lo, hi = anchor_stretches(at, np.arange(len(at)) + SIZE <= ends[: len(at)])
    whole = span_hashes(codes, SIZE)
    with np.errstate(over="ignore"):
        same = mix(whole[lo] * np.uint64(3) + mix(whole[hi]) + (hi - lo).astype(np.uint64))
    return grams[at[lo]], same, lo + begin, hi + begin


def _stretches(data: np.ndarray, offsets: np.ndarray):
    """Slices of a block take turns, as hashes need a hundred times the bytes that they are of. A slice has the stretches that begin in it; it sees one byte
    before them, and REACH bytes behind, where the last one ends at most."""
    n, found = len(data), []
    for first in range(0, max(1, n), SLICE_BYTES):
        begin, end = max(0, first - 1), min(n, first + SLICE_BYTES + REACH)
        inner = offsets[1:][(offsets[1:] > begin) & (offsets[:-1] < end)] - begin
        ends = np.repeat(inner, np.diff(np.minimum(np.append(0, inner), end - begin)))
        key, same, lo, hi = _slice_stretches(data[begin:end], ends, begin)
        own = (lo >= first) & (lo < first + SLICE_BYTES)
        found.append((key[own], same[own], lo[own], hi[own]))
    key, same, lo, hi = (np.concatenate(x) for x in zip(*found))
    text = np.searchsorted(offsets, lo, "right") - 1
    return key, same, text, lo - offsets[text], hi - offsets[text]


def _details(data: np.ndarray, offsets: np.ndarray, ids, rows, text, lo, hi, hot, key):
    size = hi - lo + SIZE
    at = ragged((offsets[:-1][text] + lo)[~hot], size[~hot])
    bounds = np.concatenate([[0], np.cumsum(size[~hot])]).astype(np.int32)
    content = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[at]))])
    yield {"key": key[~hot], "check": np.zeros(len(bounds) - 1, np.int64), "text": text[~hot], "lo": lo[~hot], "hi": hi[~hot], "content": content}
    if hot.any():
        # only the hot stretches' own bytes are hashed, joined
        long = size[hot]
        codes = BYTE_CODE[data[ragged((offsets[:-1][text] + lo)[hot], long)]]
        one, two = mix(span_hashes(codes, SIZE)), span_hashes(mix(codes), SIZE)
        k, c, t, p = window_rows(one, two, np.arange(len(long)), lo[hot], hi[hot], np.cumsum(long) - long - lo[hot])
        t = text[hot][t]
        again = repeats_of_windows(k, c, ids[t], rows[t], p, False)
        # what is a repeat within the block is known; it goes on by another key that only it has
        with np.errstate(over="ignore"):
            k = np.where(again, mix(k + mix(p.astype(np.uint64) + (t.astype(np.uint64) << np.uint64(40)))), k)
        flag = pa.array([b"again" if a else None for a in again], pa.binary())
        yield {"key": k.view(np.int64), "check": c.view(np.int64), "text": t, "lo": p, "hi": p, "content": flag}


def _compare(table: pa.Table):
    key, check, doc, row, lo, hi = (table.column(c).to_numpy() for c in ("key", "check", "doc_id", "row", "lo", "hi"))
    content = table.column("content").combine_chunks()
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    length = np.asarray(pa.compute.binary_length(content).fill_null(0))
    again = length == 5
    single = length == 0
    single_at = np.flatnonzero(single)
    repeat = repeats_of_windows(key[single], check[single], doc[single], row[single], lo[single], False)
    out = [(doc[again], row[again], lo[again], hi[again]), (doc[single_at[repeat]], row[single_at[repeat]], lo[single_at[repeat]], hi[single_at[repeat]])]
    full = np.flatnonzero(length >= SIZE)
    if len(full):
        taken = content.take(pa.array(full)).cast(pa.large_binary())
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = np.frombuffer(taken.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lengths, first, places = maximal_repeats((data, offsets), SIZE)
        if len(lengths):
            seg = np.searchsorted(offsets, places, "right") - 1
            within = places - offsets[seg] + lo[full][seg]
            age = np.empty(len(places), np.int64)
            age[np.lexsort([within, row[full][seg], doc[full][seg]])] = np.arange(len(places))
            group = np.repeat(np.arange(len(lengths)), np.diff(first))
            # occurrences that start at one place of one row are one, as where stretches overlap
            least = np.minimum.reduceat(age, first[:-1])[group]
            owner = np.empty(len(places), np.int64)
            owner[age] = np.arange(len(places))
            origin = owner[least]
            later = (doc[full][seg] != doc[full][seg[origin]]) | (row[full][seg] != row[full][seg[origin]]) | (within != within[origin])
            out.append((doc[full][seg[later]], row[full][seg[later]], within[later], (within + lengths[group] - SIZE)[later]))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lo, hi): windows lo .. hi of the document start earlier elsewhere, too; counted in bytes."""
    return repeated_stretches(docs, _stretches, _details, _compare, other_docs_only=False)


def _kept(docs: DataFrame, found: DataFrame, make, schema: str) -> DataFrame:
    def apply(batches):
        for (ids, runs), data, offsets in blocks(batches, ("doc_id", "runs"), TAKEN_BYTES):
            gone = covered(runs, offsets, len(data), SIZE)
            yield make(ids, data, offsets, gone)

    return with_stretches(docs, found).mapInArrow(apply, schema)


def removal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def digest(ids, data, offsets, gone):
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[offsets[1:]] - total[offsets[:-1]]
        starts, _ = runs_of(gone, offsets)
        n_spans = np.diff(np.searchsorted(starts, offsets))
        kept = memoryview(np.ascontiguousarray(data[~gone]))
        bounds = offsets - total[offsets]
        sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.record_batch([ids, pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _kept(docs, repeats(docs), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): every document's remaining bytes; characters cut in two are dropped."""
    return _kept(docs, repeats(docs), lambda ids, data, offsets, gone: pa.record_batch([ids, _remaining(data, offsets, gone)], ["doc_id", "kept"]), "doc_id long, kept string")


def _remaining(data, offsets, gone) -> pa.Array:
    total = np.concatenate([[0], np.cumsum(gone)])
    kept = data[~gone].tobytes()
    bounds = offsets - total[offsets]
    return pa.array([kept[a:b].decode(errors="ignore") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())


def rewritten(docs: DataFrame) -> DataFrame:
    """The rows of documents, each with the remaining bytes of its own text; rows without doc_id go."""
    runs = repeats(docs).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    rows = docs.where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    names, place = docs.columns, docs.columns.index("text")

    def apply(batches):
        for batch in batches:
            columns = batch.columns
            all_columns = columns[0].flatten()
            texts = pa.record_batch([*all_columns, columns[1]], [*(str(i) if i != place else "text" for i in range(len(all_columns))), "runs"])
            for part, data, offsets in blocks([texts], texts.schema.names, TAKEN_BYTES):
                part[place] = _remaining(data, offsets, covered(part.pop(), offsets, len(data), SIZE))
                yield pa.record_batch(part, names)

    # a struct holds the columns, so that none clashes
    held = rows.select(F.struct(*names).alias("held"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    return held.join(runs, ["doc_id", "row"], "left").select("held", "runs").mapInArrow(apply, rows.schema)
