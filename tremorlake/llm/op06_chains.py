"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: KINDS kinds of toxic documents, and at last "toxic" itself. The labels know only
"toxic", so the kinds are found in the labelled rows: clusters of toxic documents by the features they share that are in excess
among them. Features are words and beginnings of words, and two views part them by a bit of their hash: the kinds are found and
predicted in the first view, "toxic" in the second, so that what the first view knows reaches "toxic" through the earlier
probabilities alone. Each classifier is a logistic regression on its view's features in a document and on the probabilities of
the categories before it. In training those probabilities come from out-of-fold models, each with features chosen from its own
fold's training rows, so that a later classifier learns from what it will meet; afterwards each category's model is fitted on
all training rows.

Training takes at most TRAIN_DOCS labelled documents (those of the least hash), no more than have TRAIN_BYTES bytes together,
one text for each doc_id, and never one with crc32(doc_id) mod 5 = 0.
A model's features are those in LEAST_DOCS training documents or more whose share of its category is off by LEAST_EXCESS
standard deviations. Null and empty texts have no words and get the constant's score; texts of any length are whole. A table
without usable labels gives 0.0. Repeated rows get equal scores; of rows that share a doc_id each is scored by itself. Empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RunHasher, blocks, clean_docs, discard, mix, words_of, written
from .op04_crf import held_out

TRAIN_DOCS, TRAIN_BYTES = 8000, 64 << 20
LEAST_DOCS = 6
#: How many standard deviations a feature's share of toxic documents has to be off.
LEAST_EXCESS = 6.0
FOLDS = 3
#: Bytes of the beginnings of words that count besides whole words.
PREFIXES = (4, 5, 6, 7, 8)

KINDS = 3
#: At most so many rounds of clustering.
CLUSTER_ROUNDS = 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter words and of their beginnings, and the text that each is in; each feature of a text once.
    That a text has a feature three times or more is a feature of its own."""
    low, hasher = LOWER[data], RunHasher()
    starts, ends, codes, first = words_of(low, offsets, _LETTER, hasher)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    all_codes, all_docs = [codes], [doc]
    for n in PREFIXES:
        longer = ends - starts > n
        all_codes.append(mix(hasher(low, starts[longer], starts[longer] + n) + np.uint64(n)))
        all_docs.append(doc[longer])
    # 16 bits of the text's place in the block and 48 of the hash sort as one number
    key = np.sort((np.concatenate(all_docs).astype(np.uint64) << np.uint64(48)) | (np.concatenate(all_codes) >> np.uint64(16)))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    often = key[at[np.diff(np.append(at, len(key))) >= 3]] ^ np.uint64(1)
    key = np.sort(np.concatenate([key[at], often]))
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64)


def _logistic(col: np.ndarray, row: np.ndarray, n_rows: int, n_cols: int, extra: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, decay: float = 2e-4) -> np.ndarray:
    """Weights of the words, then of the extra columns, by Adam; the classes weigh as they occur."""
    theta = np.zeros(n_cols + extra.shape[1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=theta[col], minlength=n_rows) + extra @ theta[n_cols:]
        r = y - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.concatenate([np.bincount(col, weights=r[row], minlength=n_cols), extra.T @ r]) / n_rows - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta


def _predict(theta, col, row, n_rows, extra):
    n_cols = len(theta) - extra.shape[1]
    z = np.bincount(row, weights=theta[:n_cols][col], minlength=n_rows) + extra @ theta[n_cols:]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _excess(of: np.ndarray, row: np.ndarray, size: int, y: np.ndarray) -> np.ndarray:
    """By how many standard deviations each feature's number of positive documents is off; 0 for rare ones."""
    n, share = np.bincount(of, minlength=size), y.mean()
    spread = np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    return np.where(n >= LEAST_DOCS, (np.bincount(of, weights=y[row], minlength=size) - n * share) / spread, 0)


def _choice(of: np.ndarray, row: np.ndarray, size: int, y: np.ndarray) -> np.ndarray:
    """The features of a model, in ascending order."""
    return np.flatnonzero(np.abs(_excess(of, row, size, y)) >= LEAST_EXCESS)


def first_view(codes: np.ndarray) -> np.ndarray:
    """Which features the kinds see; "toxic" sees the others."""
    return codes & np.uint64(2) == 0


def kinds_of(of: np.ndarray, row: np.ndarray, view: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """For each kind which documents are of it; kinds share none. Clusters of the toxic documents by the angle between their features in excess: the first center is the
    document nearest to their mean, each next one that furthest from the centers so far, and of equals the first counts. Documents without such features are of no kind."""
    chosen = np.flatnonzero((_excess(of, row, len(view), toxic) >= LEAST_EXCESS) & view)
    place = np.full(len(view), -1)
    place[chosen] = np.arange(len(chosen))
    use = (place[of] >= 0) & (toxic[row] > 0)
    docs, at = np.unique(row[use], return_inverse=True)
    col, kinds = place[of][use], [np.zeros(len(toxic)) for _ in range(KINDS)]
    if not len(docs):
        return kinds
    length = 1 / np.sqrt(np.bincount(at))
    mean_of = lambda inside: np.bincount(col[inside[at]], weights=length[at[inside[at]]], minlength=len(chosen))
    unit = lambda c: c / max(1e-12, float(np.linalg.norm(c)))
    near = lambda c: np.round(length * np.bincount(at, weights=c[col], minlength=len(docs)), 9)
    one = lambda k: unit(mean_of(np.arange(len(docs)) == k))
    centers = [one(np.argmax(near(unit(mean_of(np.ones(len(docs), bool))))))]
    while len(centers) < KINDS:
        centers.append(one(np.argmin(np.max([near(c) for c in centers], axis=0))))
    mine = None
    for _ in range(CLUSTER_ROUNDS):
        before, mine = mine, np.argmax([near(c) for c in centers], axis=0)
        if before is not None and (before == mine).all():
            break
        centers = [unit(mean_of(mine == k)) if (mine == k).any() else c for k, c in enumerate(centers)]
    for k in range(KINDS):
        kinds[k][docs[mine == k]] = 1
    return kinds


def train_chain(codes: np.ndarray, row: np.ndarray, n_rows: int, toxic: np.ndarray, folds: int = FOLDS, chained: bool = True) -> dict:
    """Vocabulary and weights of each category, in the order of the chain. Without ``chained`` no category sees those before it, to measure what they add."""
    vocabulary, of = np.unique(codes, return_inverse=True)
    view = first_view(vocabulary)

    def fitted(inside: np.ndarray, extra: np.ndarray, y: np.ndarray, seen: np.ndarray):
        """A model of the rows inside: its features and weights, and the probabilities of all other rows."""
        number, at = np.cumsum(inside) - 1, inside[row]
        chosen = _choice(of[at], number[row[at]], len(vocabulary), y[inside])
        chosen = chosen[seen[chosen]]
        place = np.full(len(vocabulary), -1)
        place[chosen] = np.arange(len(chosen))
        col = place[of]
        use = at & (col >= 0)
        theta = _logistic(col[use], number[row[use]], int(inside.sum()), len(chosen), extra[inside], y[inside])
        rest, use = np.cumsum(~inside) - 1, ~at & (col >= 0)
        return chosen, theta, _predict(theta, col[use], rest[row[use]], int((~inside).sum()), extra[~inside])

    fold, every = np.arange(n_rows) % folds, np.ones(n_rows, bool)
    extra, models = np.ones((n_rows, 1)), []
    for y, seen in (*((k, view) for k in kinds_of(of, row, view, toxic)), (toxic, ~view)):
        out_of_fold = np.zeros(n_rows)
        for k in range(folds):
            out_of_fold[fold == k] = fitted(fold != k, extra, y, seen)[2]
        models.append(fitted(every, extra, y, seen)[:2])
        extra = np.hstack([extra, out_of_fold[:, None] if chained else np.zeros((n_rows, 1))])
    used = np.unique(np.concatenate([chosen for chosen, _ in models]))
    weights = []
    for chosen, theta in models:
        wide = np.zeros(len(used) + len(theta) - len(chosen))
        wide[np.searchsorted(used, chosen)] = theta[: len(chosen)]
        wide[len(used) :] = theta[len(chosen) :]
        weights.append(wide)
    return {"vocabulary": vocabulary[used], "weights": weights}


def frequent(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur in LEAST_DOCS documents or more, and their documents' numbers; sizes: codes of each document, in their order. No model chooses a rarer one, and
    most are, so training needs a fraction of the memory."""
    order = np.sort(codes)  # a document has a code once
    ends = order[LEAST_DOCS - 1 :]
    often = ends[ends == order[: len(ends)]]
    del order, ends
    known = often[np.append(True, often[1:] != often[:-1])[: len(often)]]
    del often
    keep = np.zeros(len(codes), bool)
    for a in range(0, len(codes) if len(known) else 0, 1 << 18):
        part = codes[a : a + (1 << 18)]
        keep[a : a + (1 << 18)] = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part
    first = np.append(0, np.cumsum(sizes))
    kept = np.append(0, np.cumsum(keep, dtype=np.int32))
    return codes[keep], np.repeat(np.arange(len(sizes), dtype=np.int32), np.diff(kept[first]))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """The chain, from at most train_docs labelled documents that are not held out; None without two classes."""
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def features(batches):
        for (ids, y), data, offsets in blocks(batches, ("doc_id", "y")):
            codes, doc = word_codes(data, offsets)
            parts = np.split(codes, np.searchsorted(doc, np.arange(1, len(ids))))
            yield pa.record_batch([ids, y, pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())], ["doc_id", "y", "codes"])

    found = clean_docs(docs).join(F.broadcast(picked), "doc_id")  # at most train_docs rows of labels
    rows = written(found.select("doc_id", "y", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n_bytes")), "training")
    # one text for each doc_id, as many as fit the bound
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "n_bytes")).alias("s"), F.max("y").alias("y")).select("doc_id", "s.*", "y")
    sizes = one.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    fits = sizes["n_bytes"].cumsum() <= TRAIN_BYTES
    if fits.sum() < FOLDS or len(set(sizes.loc[fits, "y"])) < 2:
        discard(rows)
        return None
    chosen = docs.sparkSession.createDataFrame(sizes.loc[fits, ["doc_id", "h", "y"]], "doc_id long, h long, y int")
    texts = rows.drop("y").join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
    got = texts.mapInArrow(features, "doc_id long, y int, codes binary").toPandas().sort_values("doc_id", kind="stable")
    discard(rows)
    y, sizes = got["y"].to_numpy(float), got["codes"].map(len).to_numpy() // 8
    codes = np.frombuffer(b"".join(got["codes"]), "<u8")
    del got
    codes, row = frequent(codes, sizes)
    return train_chain(codes, row, len(y), y)


def toxicity(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, a probability for each kind, score, predicted) of every document; score is that of "toxic"."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"p_kind_{k + 1}" for k in range(KINDS)]
    names = ["doc_id", *kinds, "score", "predicted"]

    def score(batches):
        m = shared.value
        for (ids,), data, offsets in blocks(batches):
            n = len(ids)
            extra = np.ones((n, 1))
            if m is None:
                extra = np.zeros((n, 2 + KINDS))
            else:
                codes, doc = word_codes(data, offsets)
                at = np.minimum(np.searchsorted(m["vocabulary"], codes), max(0, len(m["vocabulary"]) - 1))
                known = m["vocabulary"][at] == codes if len(m["vocabulary"]) else np.zeros(len(codes), bool)
                for theta in m["weights"]:
                    extra = np.hstack([extra, _predict(theta, at[known], doc[known], n, extra)[:, None]])
            p = extra[:, 1:]
            yield pa.record_batch([ids, *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(p[:, -1] >= threshold).cast(pa.int32())], names)

    schema = "doc_id long, " + ", ".join(f"{k} double" for k in kinds) + ", score double, predicted int"
    out = clean_docs(docs).mapInArrow(score, schema)
    return out.withColumn("held_out", held_out("doc_id"))
