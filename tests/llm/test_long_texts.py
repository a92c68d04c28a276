"""The line model on texts of very many lines, against a plain loop."""

import time
import tracemalloc

import numpy as np
import pytest

from tests.llm import cases
from tremorlake.llm import op04_crf as op
from tremorlake.llm.common import blocks, clean_docs


def plain_marginals(score, moves):
    """P(good) of each line of one chain, line by line."""
    n = len(score)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        if t:
            alpha[t] = [np.logaddexp(alpha[t - 1, 0] + moves[0, j], alpha[t - 1, 1] + moves[1, j]) for j in (0, 1)]
        alpha[t, 1] += score[t]
    for t in range(n - 2, -1, -1):
        q = beta[t + 1] + [0, score[t + 1]]
        beta[t] = [np.logaddexp(q[0] + moves[i, 0], q[1] + moves[i, 1]) for i in (0, 1)]
    total = alpha + beta
    return 1 / (1 + np.exp(total[:, 0] - total[:, 1]))


def a_model(rng):
    n = 4 * op._N + 3
    return {"weights": rng.normal(size=n) / 3, "mean": rng.normal(size=n), "dev": 1 + rng.random(n), "moves": rng.normal(size=(2, 2)), "curve": (1.3, -0.2)}


def as_block(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in data])])


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_chains_cut_into_runs(monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    first = np.cumsum([0, 1, 2, 3, 4, 9, 1, 40, 30, 2])
    score, moves = rng.normal(size=first[-1]) * 4, rng.normal(size=(2, 2)) * 2
    good, pairs, _ = op.forward_backward(score, moves, first)
    assert np.allclose(good, np.concatenate([plain_marginals(score[a:b], moves) for a, b in zip(first[:-1], first[1:])]), atol=1e-12)
    assert np.isclose(pairs.sum(), first[-1] - len(first) + 1)
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    assert np.allclose(pairs[:, 1].sum(), good[inner].sum())


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    """The whole score of each text: features, neighbours, marginals, length-weighted mean and calibration."""
    rng = np.random.default_rng(5)
    model = a_model(rng)
    rows = cases.documents(31, 40) + [(90, "a\n\nb\n" * 50, "", 1, 1, ""), (91, "\n", "", 1, 1, ""), (92, "x\n" * 9 + "y" * 300 + "\n\n", "", 1, 1, "")]
    want = {}
    for d, text, *_ in rows:
        x, length, first = op.line_features(*as_block([text or ""]))
        assert len(x) == (text or "").count("\n") + 1
        score = (op.chain_inputs(x, first) - model["mean"]) / model["dev"] @ model["weights"]
        mean = np.average(plain_marginals(score, model["moves"]), weights=length + 0.01)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        want[d] = 1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2)))
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    for lines, size in ((1 << 15, 1 << 20), (3, 1 << 20), (1 << 15, 40)):
        monkeypatch.setattr(op, "SLICE_LINES", lines)
        monkeypatch.setattr(op, "SLICE_BYTES", size)
        for batch in clean_docs(docs).toArrow().to_batches():
            for (ids,), data, offsets in blocks([batch]):
                mean = op.weighted_marginals(model, *op.line_scores(model, data, offsets))
                got = 1 / (1 + np.exp(-(1.3 * op._logit(mean) - 0.2)))
                assert all(np.isclose(g, want[i], atol=1e-9) for i, g in zip(ids.to_pylist(), got))
    assert {r.doc_id: round(r.score, 9) for r in op.quality(docs, model).collect()} == {i: round(s, 9) for i, s in want.items()}


def test_four_megabytes_of_short_lines():
    model = a_model(np.random.default_rng(6))
    for text in ("\n" * (4 << 20), "a\n" * (2 << 20)):
        data, offsets = as_block([text])
        began = time.time()
        tracemalloc.start()
        got = op.weighted_marginals(model, *op.line_scores(model, data, offsets))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0 <= got[0] <= 1 and peak < 500e6 and time.time() - began < 60


def test_training_is_bounded_in_lines_and_bytes(spark, monkeypatch):
    rows = [(i, ("good words here. " if i % 2 else "$$ || ##\n") * 20) for i in range(60)] + [(7, "of the same doc_id"), (7, "of the same doc_id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(8, 1)], "doc_id long, quality int")
    seen = []
    inner = op.train_chain
    monkeypatch.setattr(op, "train_chain", lambda x, first, y: seen.append((len(x), len(first) - 1)) or inner(x, first, y))
    assert op.fit(docs, labels)
    monkeypatch.setattr(op, "TRAIN_LINES", 100)
    assert op.fit(docs, labels)
    assert seen[1][0] <= 100 < seen[0][0] and seen[1][1] < seen[0][1] <= 60
    monkeypatch.setattr(op, "TRAIN_BYTES", 10)
    assert op.fit(docs, labels) is None
