"""Repeated windows across a corpus, found by content-chosen anchors: the part that byte and word operators share.

A window is ``size`` neighbouring items (bytes, words) of one text. Each window names an anchor that its own content
decides, so equal windows name equal anchors wherever they stand. Neighbouring windows with one anchor are a stretch.

1. Each task turns its texts into stretches. Equal stretches within a block of text are merged there: the first stays,
   the others are already known to be repeats. So one key that a third of all rows hold shrinks before the shuffle.
2. Stretches meet by anchor. Of equal ones all but the first are repeats, whole. An anchor with only one distinct
   stretch is done; the first of each distinct stretch of other anchors needs a closer look (a few per cent).
3. Those are cut out of their texts and compared item by item (``compare``), where few share an anchor; where more than
   HOT do, single windows meet by their hashes instead, which spreads them evenly.
4. The repeated stretches of each document are gathered and applied to its text.

Rows are told apart by doc_id and a hash of their text (``row``): repeated rows are one occurrence, not repeats of each
other, and what is found in one text is never applied to another that has its doc_id.

Windows are judged on the input. Keys are 64-bit hashes and stretches compare by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, clean_docs, mix, written

#: Distinct stretches of one anchor up to which they are compared with each other in one task.
HOT = 64
#: Rows of sorted keys that a worker handles at once, if no key has more.
CHUNK_ROWS = 150_000
#: The same for rows with their content, whose comparison needs some hundred bytes for each byte of it.
COMPARED_ROWS = 4000

STRETCH = "key long, same long, doc_id long, row long, lo long, hi long, done boolean"
FOUND = "key long, doc_id long, row long, lo long, hi long, n long"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def anchor_stretches(anchor: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of valid windows with one anchor position."""
    n = len(anchor)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new, last = valid.copy(), valid.copy()
    differs = anchor[1:] != anchor[:-1]
    new[1:] &= differs | ~valid[:-1]
    last[:-1] &= differs | ~valid[1:]
    return np.flatnonzero(new), np.flatnonzero(last)


def new_occurrence(same_as_before: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """False where a row, in sorted order, is of the class and the place (doc_id, row, lo) of the one before it."""
    out = ~same_as_before
    for x in place:
        out[1:] |= x[1:] != x[:-1]
    return out


def merge_runs(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unites ranges of windows of a row that touch."""
    if not len(doc):
        return doc, row, lo, hi
    order = np.lexsort([lo, row, doc])
    doc, row, lo, hi = doc[order], row[order], lo[order], hi[order]
    reach = np.zeros(len(doc), np.int64)
    bounds = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))), len(doc))
    shift = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, lo[1:] + shift[1:] > reach[:-1] + 1)
    start = np.flatnonzero(new)
    return doc[start], row[start], lo[start], np.maximum.reduceat(hi, start)


def first_flags(same_as_before: np.ndarray, doc: np.ndarray, other_docs_only: bool) -> np.ndarray:
    """True where a row, in sorted order, is no repeat of a row of its class: it opens it, or (if only other documents
    count) it is of the document that does."""
    new = ~same_as_before
    if not other_docs_only:
        return new
    at = np.flatnonzero(new)
    return doc == np.repeat(doc[at], np.diff(np.append(at, len(doc))))


def _occurrences(key, same, doc, row, lo, hi):
    """Stretches in order, each place once, and which are equal to the one before."""
    order = np.lexsort([lo, row, doc, same, key])
    key, same, doc, row, lo, hi = (x[order] for x in (key, same, doc, row, lo, hi))
    equal = np.append(False, (key[1:] == key[:-1]) & (same[1:] == same[:-1])) if len(key) else np.zeros(0, bool)
    return [x[new_occurrence(equal, doc, row, lo)] for x in (key, same, doc, row, lo, hi, equal)]


def _block_rows(key, same, doc, row, lo, hi, other_docs_only):
    """Stretches of a block after merging equal ones."""
    key, same, doc, row, lo, hi, equal = _occurrences(key, same, doc, row, lo, hi)
    first = first_flags(equal, doc, other_docs_only)
    rdoc, rrow, rlo, rhi = merge_runs(doc[~first], row[~first], lo[~first], hi[~first])
    with np.errstate(over="ignore"):
        spread = mix(rdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rlo.astype(np.uint64))
    n = len(rdoc)
    return pa.record_batch(
        [pa.array(np.concatenate([_signed(key[first]), _signed(spread)])), pa.array(np.concatenate([_signed(same[first]), np.zeros(n, np.int64)])), pa.array(np.concatenate([doc[first], rdoc])), pa.array(np.concatenate([row[first], rrow])), pa.array(np.concatenate([lo[first], rlo])), pa.array(np.concatenate([hi[first], rhi])), pa.array(np.concatenate([np.zeros(int(first.sum()), bool), np.ones(n, bool)]))],
        ["key", "same", "doc_id", "row", "lo", "hi", "done"],
    )


def by_key(batches, rows: int = CHUNK_ROWS):
    """Tables of whole keys from batches sorted by their first column."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
            rows = max(rows, 2 * n if not cut else rows)
    if n:
        yield pa.Table.from_batches(held)


def _resolve(other_docs_only):
    def resolve(batches):
        for table in by_key(batches):
            key, same, doc, row, lo, hi = (table.column(c).to_numpy() for c in ("key", "same", "doc_id", "row", "lo", "hi"))
            done = table.column("done").to_numpy(zero_copy_only=False)
            out = [(np.zeros(int(done.sum()), np.int64), doc[done], row[done], lo[done], hi[done], np.full(int(done.sum()), -1))]
            key, same, doc, row, lo, hi = (x[~done] for x in (key, same, doc, row, lo, hi))
            if len(key):
                key, same, doc, row, lo, hi, equal = _occurrences(key, same, doc, row, lo, hi)
                new_key = np.append(True, key[1:] != key[:-1])
                first = first_flags(equal, doc, other_docs_only)
                group = np.cumsum(new_key) - 1
                n = np.bincount(group, weights=~equal).astype(np.int64)[group]
                rdoc, rrow, rlo, rhi = merge_runs(doc[~first], row[~first], lo[~first], hi[~first])
                out.append((np.zeros(len(rdoc), np.int64), rdoc, rrow, rlo, rhi, np.full(len(rdoc), -1)))
                look = first & (n > 1)
                out.append((key[look], doc[look], row[look], lo[look], hi[look], n[look]))
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["key", "doc_id", "row", "lo", "hi", "n"])

    return resolve


def by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of clean documents."""
    return clean_docs(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")


def repeated_stretches(docs: DataFrame, stretches, details, compare, other_docs_only: bool) -> DataFrame:
    """(doc_id, row, lo, hi): first and last repeated window of stretches of windows.

    stretches(data, offsets) -> key, same (uint64), text index, lo, hi of a block's stretches.
    details(data, offsets, doc_ids, rows, text index, lo, hi, hot, key) -> dicts of rows for compare: key, check, text, lo, hi, content.
    compare(table) -> doc_id, row, lo, hi of the repeats among whole keys.
    """
    texts = by_text(docs)

    def find(batches):
        for (ids, rows), data, offsets in blocks(batches, ("doc_id", "row")):
            ids, rows = np.asarray(ids), np.asarray(rows)
            key, same, text, lo, hi = stretches(data, offsets)
            yield _block_rows(key, same, ids[text], rows[text], lo, hi, other_docs_only)

    rows = texts.mapInArrow(find, STRETCH).repartition("key").sortWithinPartitions("key")
    found = written(rows.mapInArrow(_resolve(other_docs_only), FOUND), "stretches")

    need = found.where("n > 1").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "lo", "hi", "n")).alias("look"))

    def cut(batches):
        for (ids, rows, look), data, offsets in blocks(batches, ("doc_id", "row", "look")):
            ids, rows = np.asarray(ids), np.asarray(rows)
            order = np.lexsort([rows, ids])
            once = np.zeros(len(ids), bool)
            once[order] = new_occurrence(np.append(False, np.ones(len(ids) - 1, bool)), ids[order], rows[order])
            text = np.repeat(np.arange(len(ids)), np.diff(np.asarray(look.offsets)))
            flat = look.flatten()
            key, lo, hi, n = (flat.field(i).to_numpy()[once[text]] for i in range(4))
            text = text[once[text]]
            for part in details(data, offsets, ids, rows, text, lo, hi, n > HOT, key):
                yield pa.record_batch([pa.array(part["key"]), pa.array(part["check"]), pa.array(ids[part["text"]]), pa.array(rows[part["text"]]), pa.array(part["lo"]), pa.array(part["hi"]), part["content"]], ["key", "check", "doc_id", "row", "lo", "hi", "content"])

    def settle(batches):
        for table in by_key(batches, COMPARED_ROWS):
            yield pa.record_batch([pa.array(x) for x in merge_runs(*compare(table))], ["doc_id", "row", "lo", "hi"])

    close = texts.join(need, ["doc_id", "row"]).select("doc_id", "row", "text", "look").mapInArrow(cut, "key long, check long, doc_id long, row long, lo long, hi long, content binary")
    settled = close.repartition("key").sortWithinPartitions("key").mapInArrow(settle, "doc_id long, row long, lo long, hi long")
    return found.where("n < 0").select("doc_id", "row", "lo", "hi").unionByName(settled)


def window_rows(hash_one, hash_two, text, lo, hi, first_item):
    """A row for each window of stretches: its hashes and place. Equal windows of a block are merged by the caller."""
    n = hi - lo + 1
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    which = np.repeat(text, n)
    place = at + first_item[which]
    return hash_one[place], hash_two[place], which, at


def repeats_of_windows(key, check, doc, row, lo, other_docs_only) -> np.ndarray:
    """For rows of single windows, which are repeats of an earlier row."""
    order = np.lexsort([lo, row, doc, check, key])
    k, c, d, r, p = key[order], check[order], doc[order], row[order], lo[order]
    equal = np.append(False, (k[1:] == k[:-1]) & (c[1:] == c[:-1])) if len(k) else np.zeros(0, bool)
    again = ~first_flags(equal, d, other_docs_only)
    if len(k):  # a place that comes several times is what it is the first time
        new = np.flatnonzero(new_occurrence(equal, d, r, p))
        again = np.repeat(again[new], np.diff(np.append(new, len(k))))
    out = np.zeros(len(key), bool)
    out[order] = again
    return out


def with_stretches(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, text, runs): each row with its repeated stretches as an array of (lo, hi), null where none."""
    runs = repeats.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return by_text(docs).join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs")


def covered(runs: pa.Array, first_item: np.ndarray, n_items: int, size: int) -> np.ndarray:
    """Mask of the items of a block that repeated windows cover; ranges are clipped to their text."""
    flat = runs.flatten()
    change = np.zeros(n_items + 1, np.int64)
    if len(flat):
        counts = np.asarray(runs.value_lengths().fill_null(0))
        text = np.repeat(np.arange(len(counts)), counts)
        lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        start = np.minimum(first_item[text] + lo, first_item[text + 1])
        end = np.minimum(first_item[text] + hi + size, first_item[text + 1])
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0
