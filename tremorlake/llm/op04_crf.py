"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of kinds of bytes and words, repetition and length, those
of the lines before and after it, and the borders of the text. The chain's weights are learned by gradient ascent on
the likelihood of labelled documents, whose lines all carry the document's label. A document's quality is the mean of
its lines' marginals of "good" from forward-backward, weighted by line length, and calibrated on the training rows.

Training takes at most TRAIN_DOCS labelled documents (those of the least hash), never one with crc32(doc_id) mod 5 = 0, and of these no
more than have TRAIN_LINES lines and TRAIN_BYTES bytes together; it sees texts and labels only. Null and empty texts are one empty line and get a
score like others. A table without usable labels gives the score 0.5 everywhere. Repeated rows get the same score, of training documents that share a
doc_id one text counts; empty tables give empty results.

Texts may have any number of lines. Lines are taken apart in slices of SLICE_LINES lines or SLICE_BYTES bytes, of which a few numbers a line stay. Chains
are cut into runs of CHUNK lines: what a run does to the odds before it is a product of 2 x 2 matrices, found for all runs at once, so that odds are carried
over runs and then found within all runs at once. Memory grows by about 100 bytes a line, and by about 60 a byte of the longest line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, RunHasher, blocks, clean_docs, discard, words_of, written

TRAIN_DOCS, TRAIN_LINES, TRAIN_BYTES = 6000, 200_000, 64 << 20
THRESHOLD = 0.3
#: Lines and bytes whose features are in memory together (one longer line is by itself), and lines of a run of the chain.
SLICE_LINES, SLICE_BYTES, CHUNK = 1 << 15, 1 << 20, 512
_N = 17

_KIND = np.zeros(256, np.uint8)  # 0 other symbols, 1 lower case and above ASCII, 2 upper case, 3 digits, 4 space, 5 stops
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes, and the index of each text's first line (one more at the end)."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # a break in a text opens another line
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    first = np.concatenate([[0], np.cumsum(1 + np.bincount(doc_of_break, minlength=n_docs))])
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    end = np.minimum(np.append(begin[1:], len(data)), offsets[1:][doc])
    has_break = np.zeros(len(begin), bool)
    ok = end > begin
    has_break[ok] = data[end[ok] - 1] == 10
    last_line = first[1:] - 1
    has_break[last_line] = False
    length = end - begin - has_break
    counts, pipes = np.zeros((len(begin), 6), np.int64), np.zeros(len(begin), np.int64)
    if len(data):
        kind, some = _KIND[data], np.flatnonzero(ok)
        for k in range(6):
            counts[some, k] = np.add.reduceat(kind == k, begin[some], dtype=np.int64)
        pipes[some] = np.add.reduceat(data == ord("|"), begin[some], dtype=np.int64)
    counts[:, 4] -= has_break
    size = np.maximum(length, 1)
    share = counts / size[:, None]
    pipes = pipes / size
    low = LOWER[data]
    starts, ends, codes, _ = words_of(low, offsets, ~SPACE, RunHasher())
    wline = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(wline, minlength=len(begin))
    w = np.maximum(n_words, 1)
    short = np.bincount(wline[ends - starts <= 3], minlength=len(begin)) / w
    long = np.bincount(wline[ends - starts >= 18], minlength=len(begin)) / w
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (wline[1:] == wline[:-1])
    repeats = np.bincount(wline[same], minlength=len(begin)) / w
    order = np.lexsort([codes, wline]) if len(codes) else np.zeros(0, np.int64)
    c, l = codes[order], wline[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (l[1:] != l[:-1])
    distinct = np.bincount(l[new], minlength=len(begin)) / w
    stop = np.zeros(len(begin))
    full = length > 0
    stop[full] = np.isin(data[begin[full] + length[full] - 1], [46, 33, 63])
    upper = np.zeros(len(begin))
    upper[full] = _KIND[data[begin[full]]] == 2
    shout = (share[:, 2] > 0.5).astype(float)
    x = np.stack([np.log1p(length), np.log1p(n_words), np.minimum(length / w, 40) / 10, *share[:, :6].T, pipes * 5, short, long, repeats, distinct, stop, upper, shout], axis=1)
    return x, length, first


def chain_inputs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features with squares, those of both neighbours, borders and a constant."""
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    is_first, is_last = np.zeros(len(x)), np.zeros(len(x))
    is_first[first[:-1]], is_last[first[1:] - 1] = 1, 1
    before[is_first > 0], after[is_last > 0] = 0, 0
    return np.hstack([x, np.minimum(x * x, 100), before, after, is_first[:, None], is_last[:, None], np.ones((len(x), 1))])


def _runs(first: np.ndarray):
    """The chains cut into runs of CHUNK lines: first line and length of each, and its place in its chain."""
    n = -(-np.diff(first) // CHUNK)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first[:-1], n) + place * CHUNK
    return begin, np.minimum(begin + CHUNK, np.repeat(first[1:], n)) - begin, place


def _by_step(begin: np.ndarray, size: np.ndarray):
    """For each step t the runs that have a line there and that line, runs of the most lines first, so that those in play are a prefix."""
    order = np.argsort(-size, kind="stable")
    sizes = -size[order]
    for t in range(int(-sizes[0]) if len(sizes) else 0):
        at = order[: np.searchsorted(sizes, -t, "left")]
        yield at, begin[at] + t


def _carry(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Odds of "good" after a move, as logarithms, given those before it."""
    return np.logaddexp(moves[0, 1], odds + moves[1, 1]) - np.logaddexp(moves[0, 0], odds + moves[1, 0])


def forward_odds(score: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log alpha(good) - log alpha(bad) of every line."""
    begin, size, place = _runs(first)
    before = np.full(len(begin), np.nan)  # odds after the line before a run
    longer = np.flatnonzero(place[1:] > 0) if len(place) else np.zeros(0, np.int64)  # runs that others follow
    if len(longer):
        # from either state before a run, the logarithms of what reaches either state at its end
        product = np.tile(np.where(np.eye(2) > 0, 0.0, -np.inf), (len(begin), 1, 1))
        mine = np.zeros(len(begin), bool)
        mine[longer] = True
        mine &= place > 0
        for at, line in _by_step(begin[mine], size[mine]):
            runs = np.flatnonzero(mine)[at]
            p = product[runs]
            product[runs] = np.stack([np.logaddexp(p[:, :, 0] + moves[0, j], p[:, :, 1] + moves[1, j]) + (score[line, None] if j else 0) for j in (0, 1)], axis=2)
        head = longer[place[longer] == 0]
        odds = np.zeros(len(begin))
        for t in range(CHUNK):  # the first runs of longer chains are whole
            line = begin[head] + t
            odds[head] = score[line] + (_carry(odds[head], moves) if t else 0)
        for k in range(1, int(place.max()) + 1):
            at = np.flatnonzero(place == k) if k == 1 else at[place[np.minimum(at + 1, len(place) - 1)] == k] + 1
            before[at] = odds[at - 1]
            p = product[at]
            x = before[at]
            odds[at] = np.logaddexp(p[:, 0, 1], x + p[:, 1, 1]) - np.logaddexp(p[:, 0, 0], x + p[:, 1, 0])
    out = np.empty(len(score))
    for t, (at, line) in enumerate(_by_step(begin, size)):
        x = before[at] if t == 0 else out[line - 1]
        start = np.isnan(x)
        out[line] = score[line] + np.where(start, 0.0, _carry(np.where(start, 0.0, x), moves))
    return out


def forward_backward(score: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """score: log-potential of "good" minus that of "bad" per line; moves[i, j]: of going from i to j (0 bad, 1 good).
    Returns P(good) per line, P(i, j) summed over each place where i goes to j, and log Z per document."""
    n = len(score)
    alpha = forward_odds(score, moves, first)
    # the chains read backwards: odds of what follows a line, the line itself included
    beta = forward_odds(score[::-1], moves.T, n - first[::-1])[::-1] - score
    good = 1 / (1 + np.exp(-np.clip(alpha + beta, -500, 500)))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    grows = np.zeros(n)
    pairs = np.zeros((2, 2))
    if len(at):
        before = alpha[at - 1]
        grows[at] = np.logaddexp(moves[0, 0], before + moves[1, 0])  # of log alpha(bad)
        to = [[moves[i, j] + (before if i else 0) + (score[at] + beta[at] if j else 0) for j in (0, 1)] for i in (0, 1)]
        z = np.logaddexp(np.logaddexp(to[0][0], to[0][1]), np.logaddexp(to[1][0], to[1][1]))
        pairs = np.array([[np.exp(x - z).sum() for x in row] for row in to])
    log_z = np.add.reduceat(grows, first[:-1]) + np.logaddexp(0, alpha[first[1:] - 1])
    return good, pairs, log_z


def train_chain(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.08, decay: float = 1e-3):
    """Weights (after scaling by mean and deviation) and moves of greatest likelihood, by Adam."""
    mean, dev = x.mean(axis=0), x.std(axis=0)
    mean[-1], dev[-1] = 0, 1
    dev[dev < 1e-9] = 1
    x = (x - mean) / dev
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    if inner.any():
        at = np.flatnonzero(inner)
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return {"mean": mean, "dev": dev, "weights": theta[:-4], "moves": theta[-4:].reshape(2, 2)}


def slices(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets) of neighbouring texts of SLICE_LINES lines and SLICE_BYTES bytes at most, or of neighbouring lines of one longer text, without
    the break at their end; they have the lines that the texts have, in the same order."""
    breaks = np.flatnonzero(data == 10)
    lines = np.cumsum(np.concatenate([[0], 1 + np.diff(np.searchsorted(breaks, offsets))]))  # lines before each text
    i = 0
    while i < len(offsets) - 1:
        j = min(np.searchsorted(lines, lines[i] + SLICE_LINES, "right"), np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        if j > i:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        else:
            j = i + 1
            ends = np.append(breaks[(breaks >= offsets[i]) & (breaks < offsets[j])], offsets[j])
            at, k = int(offsets[i]), 0
            while k < len(ends):
                m = max(k, min(k + SLICE_LINES, int(np.searchsorted(ends, at + SLICE_BYTES, "right"))) - 1)
                yield data[at : ends[m]], np.array([0, ends[m] - at])
                at, k = int(ends[m]) + 1, m + 1
        i = j


def line_scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-potential and the length of each line, and the index of each text's first line, in the model's weights: those of chain_inputs
    taken apart, so that only four numbers of a line are kept beyond its slice."""
    w = model["weights"] / model["dev"]
    own, square, before, after, at_first, at_last, one = np.split(w, [_N, 2 * _N, 3 * _N, 4 * _N, 4 * _N + 1, 4 * _N + 2])
    parts = []
    for part, cuts in slices(data, offsets):
        x, length, _ = line_features(part, cuts)
        parts.append((x @ own + np.minimum(x * x, 100) @ square, x @ before, x @ after, length))
    score, from_before, from_after, length = (np.concatenate(p) for p in zip(*parts))
    n_lines = 1 + np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets))
    first = np.concatenate([[0], np.cumsum(n_lines)])
    score += one[0] - (model["mean"] * w).sum()
    is_first, is_last = np.zeros(len(score), bool), np.zeros(len(score), bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    score[1:] += np.where(is_first[1:], 0, from_before[:-1])
    score[:-1] += np.where(is_last[:-1], 0, from_after[1:])
    return score + is_first * at_first[0] + is_last * at_last[0], length, first


def weighted_marginals(model: dict, score: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the lines' P(good), weighted by length (empty lines weigh a little)."""
    alpha = forward_odds(score, model["moves"], first)
    beta = forward_odds(score[::-1], model["moves"].T, len(score) - first[::-1])[::-1] - score
    good = 1 / (1 + np.exp(-np.clip(alpha + beta, -500, 500)))
    weight = length + 0.01
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _calibrate(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the marginals, by Newton steps with a little damping."""
    z = np.stack([_logit(p), np.ones(len(p))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-z @ b))
        h = (z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(2)
        b = b + np.linalg.solve(h, z.T @ (y - q) - 0.1 * (b - [1, 0]))
    return float(max(b[0], 0.05)), float(b[1])


def held_out(doc_id) -> F.Column:
    return F.expr(f"crc32(cast({doc_id} as string)) % 5 = 0")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """The model, from at most train_docs labelled documents that are not held out; None without two classes."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    found = clean_docs(docs).join(F.broadcast(picked), "doc_id")  # at most train_docs of them
    n_lines = F.length(F.regexp_replace("text", "[^\n]+", "")) + 1
    rows = written(found.select("doc_id", "y", "text", F.xxhash64("text").alias("h"), n_lines.alias("n_lines"), F.octet_length("text").alias("n_bytes")), "training")
    # one text for each doc_id, as many as fit the bounds
    one = rows.groupBy("doc_id").agg(F.min("h").alias("h"))
    sizes = rows.join(F.broadcast(one), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.max("n_lines").alias("n_lines"), F.max("n_bytes").alias("n_bytes"), F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    fits = (sizes["n_lines"].cumsum() <= TRAIN_LINES) & (sizes["n_bytes"].cumsum() <= TRAIN_BYTES)
    if len(set(sizes.loc[fits, "y"])) < 2:
        discard(rows)
        return None
    chosen = docs.sparkSession.createDataFrame(sizes.loc[fits, ["doc_id", "h", "y"]])

    def features(batches):
        for (ids, y), data, offsets in blocks(batches, ("doc_id", "y")):
            for k, (i, label) in enumerate(zip(ids.to_pylist(), y.to_pylist())):
                parts = [line_features(*s)[:2] for s in slices(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))]
                x, length = (np.concatenate(p) for p in zip(*parts))
                yield pa.record_batch([pa.array([i]), pa.array([label], pa.int32()), pa.array([x.astype("<f4").tobytes()]), pa.array([length.astype("<i8").tobytes()])], ["doc_id", "y", "x", "length"])

    # repeated rows are the same text: any of them
    texts = rows.drop("y").join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", F.col("y").cast("int").alias("y"), "text")
    got = texts.mapInArrow(features, "doc_id long, y int, x binary, length binary").toPandas().sort_values("doc_id", kind="stable")
    discard(rows)
    y = got["y"].to_numpy(float)
    parts = [np.frombuffer(b, "<f4").reshape(-1, _N) for b in got["x"]]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x, length = chain_inputs(np.concatenate(parts).astype(float), first), np.concatenate([np.frombuffer(b, "<i8") for b in got["length"]])
    model = train_chain(x, first, y)
    return model | {"curve": _calibrate(weighted_marginals(model, (x - model["mean"]) / model["dev"] @ model["weights"], length, first), y)}


def quality(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for (ids,), data, offsets in blocks(batches):
            if m is None:
                p = np.full(len(ids), 0.5)
            else:
                mean = weighted_marginals(m, *line_scores(m, data, offsets))
                p = 1 / (1 + np.exp(-(m["curve"][0] * _logit(mean) + m["curve"][1])))
            yield pa.record_batch([ids, pa.array(p), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    out = clean_docs(docs).mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
