"""Substring dedup by recompression.

Words become symbols. In each round a run of one symbol becomes a symbol, then pairs do: a symbol of one half of the
alphabet followed by one of the other half (halves are drawn by hash, anew in each round). Names are hashes of what they
stand for, so they are global without a dictionary, and equal passages get equal symbols but for a few at their borders.
How far the words reach that decide a symbol is carried along; a window *owns* a symbol if it holds all of those words.
Equal windows own equal symbols, so the least-named phrase of symbols that a window owns, of any level, is its anchor; windows
without one stand for themselves. Spark brings windows with a common anchor together and verifies them (repeats.py).

Words are runs of bytes other than white space. Null texts have none; texts of fewer than WINDOW words lose nothing;
repeats within one document don't count. Rows that share a doc_id count as one document. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, RunHasher, blocks, mix, ragged, span_hashes, words_of
from .repeats import anchor_stretches, covered, repeated_stretches, repeats_of_windows, window_rows, with_stretches

WINDOW = 13
ROUNDS = 2
#: Symbols of each round that make an anchor together.
PHRASE = (3, 2)
_FAR = np.int64(1) << np.int64(40)
_PLACE = np.uint64(0x3FFFFFFF)


def recompress(codes: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> list[dict]:
    """For each round the symbols: name, text, first and last word, and the words lo .. hi that decide them."""
    n = len(codes)
    at = np.arange(n)
    now = {"name": codes, "text": text, "first": at, "last": at, "lo": at, "hi": at}
    levels = []
    with np.errstate(over="ignore"):
        for k in range(rounds):
            now = _pairs(_runs(now), np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
            levels.append(now)
    return levels


def _beside(s: dict) -> tuple[np.ndarray, np.ndarray]:
    """What the symbols before and after reach; a text's border is out of any window's reach."""
    before, after = np.full(len(s["lo"]), -_FAR), np.full(len(s["lo"]), _FAR)
    same = s["text"][1:] == s["text"][:-1]
    before[1:] = np.where(same, s["lo"][:-1], -_FAR)
    after[:-1] = np.where(same, s["hi"][1:], _FAR)
    return before, after


def _runs(s: dict) -> dict:
    n = len(s["name"])
    if not n:
        return s
    new = np.append(True, (s["name"][1:] != s["name"][:-1]) | (s["text"][1:] != s["text"][:-1]))
    i = np.flatnonzero(new)
    j = np.append(i[1:], n) - 1
    length = (j - i + 1).astype(np.uint64)
    before, after = _beside(s)
    name = np.where(length > 1, mix(s["name"][i] + length * np.uint64(0xC2B2AE3D27D4EB4F)), s["name"][i])
    return {"name": name, "text": s["text"][i], "first": s["first"][i], "last": s["last"][j], "lo": np.minimum(s["lo"][i], before[i]), "hi": np.maximum(s["hi"][j], after[j])}


def _pairs(s: dict, salt: np.uint64) -> dict:
    n = len(s["name"])
    if n < 2:
        return s
    left = (mix(s["name"] ^ salt) >> np.uint64(63)) == 1
    opens = np.append(left[:-1] & ~left[1:] & (s["text"][1:] == s["text"][:-1]), False)
    closes = np.append(False, opens[:-1])
    before, after = _beside(s)
    lo = np.where(~left & ~closes, np.minimum(s["lo"], before), s["lo"])
    hi = np.where(left & ~opens, np.maximum(s["hi"], after), s["hi"])
    i = np.flatnonzero(~closes)
    two = opens[i]
    j = i + two
    name = np.where(two, mix(s["name"][i] * np.uint64(0x165667B19E3779F9) + mix(s["name"][j])), s["name"][i])
    return {"name": name, "text": s["text"][i], "first": s["first"][i], "last": s["last"][j], "lo": np.minimum(lo[i], lo[j]), "hi": np.maximum(hi[i], hi[j])}


def _phrases(s: dict, size: int) -> dict:
    """Neighbouring symbols taken together, as one alone is too common; a phrase that crosses texts is out of reach."""
    n = max(0, len(s["name"]) - size + 1)
    inside = s["text"][:n] == s["text"][size - 1 :][:n]
    lo, hi = s["lo"][:n], s["hi"][:n]
    for k in range(1, size):
        lo, hi = np.minimum(lo, s["lo"][k : k + n]), np.maximum(hi, s["hi"][k : k + n])
    return {"name": span_hashes(s["name"], size), "lo": np.where(inside, lo, -_FAR), "hi": hi}


def anchors(codes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor (a number of its symbol's place) and the anchor's name."""
    n = max(0, len(codes) - window + 1)
    levels = [_phrases(s, k) for s, k in zip(recompress(codes, text), PHRASE)]
    name, lo, hi = (np.concatenate([s[c] for s in levels]) for c in ("name", "lo", "hi"))
    mine = hi - lo < window
    number = np.flatnonzero(mine)
    value = (mix(name[number]) & ~_PLACE) | number.astype(np.uint64)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    low, high = np.maximum(hi[number] - window + 1, 0), np.minimum(lo[number], n - 1)  # windows that own the symbol
    for d in range(window):
        at = low + d
        ok = at <= high
        np.minimum.at(best, at[ok], value[ok])
    none = best == np.iinfo(np.uint64).max
    place = (best & _PLACE).astype(np.int64)
    place[none] = len(name) + np.flatnonzero(none)
    key = np.zeros(n, np.uint64)
    key[~none] = mix(name[place[~none]])
    key[none] = mix(span_hashes(codes, window)[none])
    return place, key


def _words(data, offsets):
    return words_of(data, offsets, ~SPACE, RunHasher())


def _stretches(data: np.ndarray, offsets: np.ndarray):
    _, _, codes, first = _words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place, key = anchors(codes, text)
    n = len(place)
    lo, hi = anchor_stretches(place, np.arange(n) + WINDOW <= first[1:][text[:n]])
    whole = span_hashes(codes, WINDOW)
    with np.errstate(over="ignore"):
        same = mix(whole[lo] * np.uint64(3) + mix(whole[hi]) + (hi - lo).astype(np.uint64))
    begin = first[:-1][text[lo]]
    return key[lo], same, text[lo], lo - begin, hi - begin


def _details(data: np.ndarray, offsets: np.ndarray, ids, rows, text, lo, hi, hot, key):
    _, _, codes, first = _words(data, offsets)
    one, two = mix(span_hashes(codes, WINDOW)), span_hashes(mix(codes), WINDOW)
    k, c, t, p = window_rows(one, two, text, lo, hi, first)
    again = repeats_of_windows(k, c, ids[t], rows[t], p, True)
    # what is a repeat within the block is known; it goes on by another key that only it has
    with np.errstate(over="ignore"):
        k = np.where(again, mix(k + mix(p.astype(np.uint64) + (t.astype(np.uint64) << np.uint64(40)))), k)
    yield {"key": k.view(np.int64), "check": c.view(np.int64), "text": t, "lo": p, "hi": p, "content": pa.array([b"again" if a else None for a in again], pa.binary())}


def _compare(table: pa.Table):
    key, check, doc, row, lo, hi = (table.column(c).to_numpy() for c in ("key", "check", "doc_id", "row", "lo", "hi"))
    again = table.column("content").is_valid().to_numpy()
    repeat = again.copy()
    repeat[~again] = repeats_of_windows(key[~again], check[~again], doc[~again], row[~again], lo[~again], True)
    return doc[repeat], row[repeat], lo[repeat], hi[repeat]


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lo, hi): windows lo .. hi of the document also start in a document of smaller doc_id; counted in words."""
    return repeated_stretches(docs, _stretches, _details, _compare, other_docs_only=True)


def _kept(ids, data, offsets, runs):
    starts, ends, _, first = _words(data, offsets)
    gone = covered(runs, first, len(starts), WINDOW)
    total = np.concatenate([[0], np.cumsum(gone)])
    size = (ends - starts)[~gone] + 1
    at = ragged(starts[~gone], size)
    joined = np.append(data, np.uint8(32))[at]
    stops = np.cumsum(size)
    joined[stops - 1] = 32
    kept_words = first - total[first]
    bounds = np.concatenate([[0], stops])[kept_words]
    return first, total[first[1:]] - total[first[:-1]], memoryview(joined.tobytes()), [(a, max(a, b - 1)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def removal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def digest(batches):
        for (ids, runs), data, offsets in blocks(batches, ("doc_id", "runs")):
            first, n_removed, kept, parts = _kept(ids, data, offsets, runs)
            yield pa.record_batch([ids, pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in parts])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_stretches(docs, repeats(docs)).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): every document's remaining words, joined by single spaces."""

    def text(batches):
        for (ids, runs), data, offsets in blocks(batches, ("doc_id", "runs")):
            _, _, kept, parts = _kept(ids, data, offsets, runs)
            yield pa.record_batch([ids, pa.array([bytes(kept[a:b]).decode() for a, b in parts], pa.string())], ["doc_id", "kept"])

    return with_stretches(docs, repeats(docs)).mapInArrow(text, "doc_id long, kept string")
