"""The quality and toxicity models: held-out accuracy, exact marginals, awkward inputs."""

import itertools
import os

import numpy as np
import pytest

from tests.llm import cases
from tremorlake.llm import op04_crf, op06_chains

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    score, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5])
    good, _, log_z = op04_crf.forward_backward(score, moves, first)
    weight = {y: np.exp(sum(score[i] * y[i] for i in range(4)) + sum(moves[y[i], y[i + 1]] for i in range(3))) for y in itertools.product((0, 1), repeat=4)}
    z = sum(weight.values())
    assert np.isclose(log_z[0], np.log(z))
    assert np.allclose(good[:4], [sum(w for y, w in weight.items() if y[i]) / z for i in range(4)])
    assert np.isclose(good[4], 1 / (1 + np.exp(-score[4])))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = op04_crf.quality(docs, op04_crf.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.9
    assert got.loc[got["quality"] == 1, "predicted"].mean() > 0.95


def test_models_take_awkward_inputs(spark):
    docs = spark.createDataFrame(cases.documents(), cases.SCHEMA)
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, i % 3 % 2, 1) for i in range(40)], "doc_id long, quality int, toxic int, key int")
    for model in (op04_crf.fit(docs, labels), None):
        out = op04_crf.quality(docs, model).toPandas()
        assert len(out) == 40 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    for model in (op06_chains.fit(docs, labels), None):
        out = op06_chains.toxicity(docs, model).toPandas()
        assert len(out) == 40 and out["score"].between(0, 1).all()
    none = labels.where("false")
    assert op04_crf.fit(docs, none) is None and op06_chains.fit(docs, none) is None
    assert op04_crf.quality(docs.where("false"), None).count() == 0


def test_toxicity_chain_learns(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{k}x" for k in range(200)]
    rows = []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[5], words[20] = rng.choice(["idiot", "scum", "pathetic"], 2)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = op06_chains.toxicity(df.drop("toxic"), op06_chains.fit(df.drop("toxic"), df.select("doc_id", "toxic"))).join(df, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95


def plain_chain(docs: list[set], toxic: list[int], folds: int = 3) -> np.ndarray:
    """Probabilities of each category for each document, with dense matrices and sets of features."""
    n, toxic = len(docs), np.array(toxic, float)
    features = sorted(set().union(*docs))

    def excess(rows, y):
        out = {}
        for f in features:
            has = [i for i in rows if f in docs[i]]
            share = np.mean([y[i] for i in rows])
            out[f] = (sum(y[i] for i in has) - len(has) * share) / max(np.sqrt(len(has) * share * (1 - share)), 1e-6) if len(has) >= op06_chains.LEAST_DOCS else 0.0
        return out

    def logistic(x, y):
        theta, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for k in range(1, 81):
            grad = x.T @ (y - 1 / (1 + np.exp(-x @ theta))) / len(y) - 2e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return theta

    def model(rows, extra, y, seen):
        chosen = [f for f, e in excess(rows, y).items() if abs(e) >= op06_chains.LEAST_EXCESS and (f & 2 == 0) == seen]
        x = np.hstack([np.array([[f in d for f in chosen] for d in docs], float).reshape(n, len(chosen)), extra])
        return lambda other: 1 / (1 + np.exp(-np.hstack([x[:, : len(chosen)], other]) @ logistic(x[rows], y[rows])))

    telling = [f for f, e in excess(range(n), toxic).items() if e >= op06_chains.LEAST_EXCESS and f & 2 == 0]
    bad = [i for i in range(n) if toxic[i] and any(f in docs[i] for f in telling)]
    points = np.array([[f in docs[i] for f in telling] for i in bad], float)
    points /= np.linalg.norm(points, axis=1)[:, None]
    unit = lambda x: x / np.linalg.norm(x)
    near = lambda centers: np.round(points @ np.array(centers).T, 9)
    centers = [points[np.argmax(near([unit(points.sum(axis=0))])[:, 0])]]
    while len(centers) < op06_chains.KINDS:
        centers.append(points[np.argmin(near(centers).max(axis=1))])
    for _ in range(op06_chains.CLUSTER_ROUNDS - 1):
        mine = near(centers).argmax(axis=1)
        centers = [unit(points[mine == k].sum(axis=0)) if (mine == k).any() else c for k, c in enumerate(centers)]
    mine = dict(zip(bad, near(centers).argmax(axis=1)))
    kinds = [np.array([float(mine.get(i) == k) for i in range(n)]) for k in range(op06_chains.KINDS)]
    assert sum(k.any() for k in kinds) >= 2
    met, known = np.ones((n, 1)), np.ones((n, 1))
    for y, seen in (*((k, True) for k in kinds), (toxic, False)):
        fold = np.zeros(n)
        for k in range(folds):
            fold[k::folds] = model([i for i in range(n) if i % folds != k], met, y, seen)(met)[k::folds]
        known = np.hstack([known, model(list(range(n)), met, y, seen)(known)[:, None]])
        met = np.hstack([met, fold[:, None]])
    return known[:, 1:]


def test_toxicity_chain_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(op06_chains, "LEAST_DOCS", 2)
    monkeypatch.setattr(op06_chains, "LEAST_EXCESS", 1.5)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        words = list(rng.choice([f"w{c}" for c in "abcdefgh"], 6)) + ([rng.choice(["foul", "vile", "base"])] if i % 3 == 0 else [])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = op06_chains.toxicity(df, op06_chains.fit(df.drop("toxic"), df.select("doc_id", "toxic"))).toPandas().sort_values("doc_id")
    codes = {}
    for i, text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        codes[i] = set(op06_chains.word_codes(raw, np.array([0, len(raw)]))[0].tolist())
    train = [i for i, _, _ in rows if not got["held_out"].tolist()[i]]
    want = plain_chain([codes[i] for i in train], [rows[i][2] for i in train])
    names = [*(f"p_kind_{k + 1}" for k in range(op06_chains.KINDS)), "score"]
    assert np.allclose(got.set_index("doc_id").loc[train, names].to_numpy(), want, atol=1e-6)


def test_earlier_categories_help_later_ones():
    """On held-out documents the loss of "toxic" is less with the earlier probabilities than without them."""
    rng = np.random.default_rng(8)
    rows, codes, toxic = [], [], []
    for i in range(1500):
        bad = i % 5 == 0
        # each toxic document says one thing of three in a word or two of ten each, shared by few documents
        said = {int(x) * 64 + 1 for x in rng.integers(0, 400, 30)} | ({(10_000 + i // 5 % 3 * 100 + int(x)) * 2 + 1 for x in rng.integers(0, 20, 3)} if bad else set())
        if not bad and rng.random() < 0.05:
            said |= {(10_000 + int(rng.integers(0, 3)) * 100 + int(rng.integers(0, 20))) * 2 + 1}
        rows += [i] * len(said)
        codes += sorted(said)
        toxic.append(float(bad))
    row, codes, toxic = np.array(rows), np.array(codes, np.uint64), np.array(toxic)
    train = np.arange(1500) % 7 > 1  # all three things are said in both parts
    number = np.cumsum(train) - 1
    loss = {}
    for chained in (True, False):
        m = op06_chains.train_chain(codes[train[row]], number[row[train[row]]], int(train.sum()), toxic[train], chained=chained)
        at = np.minimum(np.searchsorted(m["vocabulary"], codes), len(m["vocabulary"]) - 1)
        known = m["vocabulary"][at] == codes
        extra = np.ones((1500, 1))
        for theta in m["weights"]:
            extra = np.hstack([extra, op06_chains._predict(theta, at[known], row[known], 1500, extra)[:, None]])
        p = np.clip(extra[~train, -1], 1e-9, 1 - 1e-9)
        y = toxic[~train]
        loss[chained] = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        # the chain is made of kinds, and each toxic document is of one at most
        assert extra.shape[1] == op06_chains.KINDS + 2
    assert loss[True] < 0.9 * loss[False], loss


def test_toxicity_takes_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a foul word"), (1, "a foul word"), (1, "another"), (None, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for model in (op06_chains.fit(docs, labels), op06_chains.fit(docs.where("false"), labels)):
        out = op06_chains.toxicity(docs, model).toPandas()
        assert sorted(out["doc_id"]) == [1, 1, 1, 2]
        assert not op06_chains.toxicity(docs.where("false"), model).count()
