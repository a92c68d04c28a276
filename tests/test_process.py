"""Local Gaussian processes against dense ones."""

import numpy as np
import pytest

from tremorlake.operators import models, process


def data(seed, n, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [(k, float(x), float(np.sin(x / 4) * 3 + i + rng.normal() * 0.5)) for i, k in enumerate(keys) for x in np.sort(rng.gamma(2, 15, n))]
    return rows + [(k, x, y + 0.3) for k, x, y in rows[:20]] + [("a", None, 1.0), ("a", 1.0, None)]


def dense(rows, key, at, support=None):
    kept = [(x, y) for k, x, y in rows if k == key and x is not None and y is not None]
    places = {}
    for x, y in kept:
        places.setdefault(x, []).append(y)
    x = np.array(sorted(places))
    y, n = (np.array([f(places[p]) for p in x], float) for f in (np.mean, len))
    return process.posterior(x, y, n, np.array(at, float), float(np.mean([y for _, y in kept])), 3.0, 0.5, support)


POINTS = [-5.0, 0.0, 10.0, 17.3, 30.0, 31.0, 55.5, 400.0]


@pytest.fixture(scope="module")
def frames(spark):
    rows = data(1, 90)
    asked = spark.createDataFrame([(k, p) for k in ("a", "b", "none") for p in POINTS] + [("a", 10.0)], "k string, at double")
    return rows, spark.createDataFrame(rows, "k string, x double, y double").repartition(3), asked


def test_one_run_is_the_dense_process(frames):
    rows, df, asked = frames
    got = {(r.k, r.at): (r.mean, r["var"]) for r in process.local_process(df, asked, ["k"], "x", "y", 3.0, 0.5, size=200).collect()}
    assert len(got) == 16
    for key in "ab":
        mean, var = dense(rows, key, POINTS)
        assert all(np.allclose(got[key, p], (m, s), atol=1e-8) for p, m, s in zip(POINTS, mean, var))
    known = models.gaussian_process(df.dropna().where("k = 'b'"), ["k"], POINTS, "x", "y", 3.0, 0.5).collect()
    assert all(np.allclose(got["b", r["at"]], (r["mean"], r["var"]), atol=1e-8) for r in known)


@pytest.mark.parametrize("support", [None, 9.0])
def test_runs_are_near_the_dense_process(frames, monkeypatch, support):
    rows, df, asked = frames
    monkeypatch.setattr(process, "PREDICTED", 2)  # points of a run in several tasks
    got = {(r.k, r.at): (r.mean, r["var"]) for r in process.local_process(df, asked, ["k"], "x", "y", 3.0, 0.5, size=25, support=support).collect()}
    assert len(got) == 16
    for key in "ab":
        mean, var = dense(rows, key, POINTS, support)
        assert all(np.allclose(got[key, p], (m, s), atol=0.05) for p, m, s in zip(POINTS, mean, var))


def test_no_rows(frames):
    _, df, asked = frames
    assert not process.local_process(df.where("false"), asked, ["k"], "x", "y", 1.0, 1.0).collect()
    assert not process.local_process(df, asked.where("false"), ["k"], "x", "y", 1.0, 1.0).collect()
