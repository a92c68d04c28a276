"""Training of the chain without the features that no model can choose."""

import tracemalloc

import numpy as np

from tremorlake.llm import op06_chains as op


def _codes(n_docs: int, rare: int):
    rng = np.random.default_rng(8)
    toxic = (rng.random(n_docs) < 0.3).astype(float)
    parts = []
    for k in range(n_docs):
        common = np.flatnonzero(rng.random(400) < np.where(np.arange(400) < 80, 0.1 + 0.5 * toxic[k], 0.3)).astype(np.uint64)
        parts.append(np.unique(np.concatenate([common, rng.integers(1000, 1 << 48, rare, dtype=np.uint64)])))
    return np.concatenate(parts), np.array([len(p) for p in parts]), toxic


def test_rare_features_change_no_model():
    codes, sizes, toxic = _codes(300, 50)
    whole = op.train_chain(codes, np.repeat(np.arange(300), sizes), 300, toxic)
    less = op.train_chain(*op.frequent(codes, sizes), 300, toxic)
    assert len(whole["vocabulary"]) > 10 and (whole["vocabulary"] == less["vocabulary"]).all()
    assert all((a == b).all() for a, b in zip(whole["weights"], less["weights"]))
    assert [len(x) for x in op.frequent(codes[:3], np.array([3]))] == [0, 0] and [len(x) for x in op.frequent(codes[:0], np.array([0]))] == [0, 0]


def test_training_takes_little_more_than_its_codes():
    codes, sizes, toxic = _codes(300, 5000)
    tracemalloc.start()
    op.train_chain(*op.frequent(codes, sizes), 300, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * codes.nbytes
