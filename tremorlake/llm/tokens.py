"""Fast exact tokenizing: texts are cut where the tokenizer surely cuts, and each distinct piece is encoded once.

The ids always come from the ``tokenizers`` library. A cut is made only before a space that stands before a
plain character, before ASCII punctuation behind a letter or digit, and behind a single line end; no token, no
special string and no lookahead of the pre-tokenizers of this family spans such a place, so that encoding the
pieces and encoding the text give the same ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import ragged

#: Pieces a worker remembers; later ones are encoded again in each block, so that memory stays bounded.
CACHE_PIECES = 400_000

_PLAIN = np.zeros(256, bool)  # bytes a piece may begin with behind the cut
_PLAIN[33:127] = True
_PLAIN[ord("<")] = False
_PLAIN[0xC3] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in '.,;:!?()"*$%&#-_/+=']] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin; pieces never cross texts."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        plain, alnum = _PLAIN[data], _ALNUM[data]
        cut[:-1] = (data[:-1] == 32) & plain[1:]
        letter = alnum
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= _PUNCT[data[1:]] & letter[:-1]
        cut[2:] |= (data[1:-1] == 10) & plain[2:] & (data[:-2] > 32) & (data[:-2] < 127)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    cut[firsts] = True
    return np.flatnonzero(cut)


def as_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.DictionaryArray:
    """The pieces as a dictionary of distinct byte strings and their indices."""
    if ends is not None:  # with gaps between them
        where = ragged(starts, ends - starts)
        data, bounds = data[where], np.concatenate([[0], np.cumsum(ends - starts)])
    else:
        bounds = np.append(starts, len(data))
    bounds = np.ascontiguousarray(bounds, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokenizers that fold case and drop white space: folded bytes, starts and ends of pieces without spaces."""
    from .common import LOWER, runs_of

    starts, ends = runs_of(~_SPACE[data], offsets)
    if b"<|" not in data.tobytes():
        data = LOWER[data]
    alnum = _ALNUM[data]
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        alnum[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] = _PUNCT[data[1:]] & alnum[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = False
    more = np.flatnonzero(cut)
    return data, np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_pieces(tokenizer, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each has."""
    if not pieces:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    got = tokenizer.encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
    ids, lens = np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))
    odd = [i for i, p in enumerate(pieces) if b"<|" in p]  # special strings are not seen in pretokenized input
    if odd:
        each = np.split(ids, np.cumsum(lens)[:-1])
        for i in odd:
            each[i] = np.array(tokenizer.encode(pieces[i].decode(), add_special_tokens=False).ids, np.uint32)
        ids, lens = np.concatenate(each), np.array([len(e) for e in each], np.int64)
    return ids, lens


class PieceEncoder:
    """Encodes blocks of texts; remembers the ids of up to CACHE_PIECES pieces."""

    def __init__(self, path: str, words: bool, cache: int = CACHE_PIECES):
        self.tokenizer, self.words, self.cache = library(path), words, cache
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts, each closed with end_id, and their counts."""
        if self.words:
            data, first, last = word_pieces(data, offsets)
            pieces = as_pieces(data, first, last)
        else:
            first = piece_starts(data, offsets)
            pieces = as_pieces(data, first)
        distinct = pieces.dictionary.to_pylist()
        index = np.fromiter((self.known.get(p, -1) for p in distinct), np.int64, len(distinct))
        miss = np.flatnonzero(index < 0)
        ids, lens = encode_pieces(self.tokenizer, [distinct[i] for i in miss])
        flat, starts, all_lens = np.concatenate([self.flat, ids]), np.concatenate([self.starts, np.cumsum(lens) - lens + len(self.flat)]), np.concatenate([self.lens, lens])
        index[miss] = np.arange(len(self.lens), len(all_lens))
        room = max(0, self.cache - len(self.known))
        if len(miss) and room:
            kept = miss[:room]
            self.known.update(zip((distinct[i] for i in kept), index[kept].tolist()))
            n = len(self.lens) + len(kept)
            end = int(starts[n - 1] + all_lens[n - 1])
            self.flat, self.starts, self.lens = flat[:end].copy(), starts[:n].copy(), all_lens[:n].copy()
        which = index[np.asarray(pieces.indices)]
        n_ids = all_lens[which]
        total = np.concatenate([[0], np.cumsum(n_ids)])
        bounds = total[np.searchsorted(first, offsets)]
        out = np.empty(bounds[-1] + len(offsets) - 1, np.uint32)
        body = flat[ragged(starts[which], n_ids)]
        counts = np.diff(bounds)
        is_end = np.zeros(len(out), bool)
        is_end[np.cumsum(counts + 1) - 1] = True
        out[~is_end] = body
        out[is_end] = end_id
        return out, counts + 1


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, words: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer file; later tasks find what earlier ones have learned."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = PieceEncoder(path, words)
    return _ENCODERS[path, words]
