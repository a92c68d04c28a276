"""Alignment by conjugate gradients and pooling over a tree, against dense forms."""

import math
import random

import numpy as np
import pytest

from tremorlake.operators import alignment, hierarchy


def a_graph(seed):
    """Components of several kinds: a path, a dense one with a tail, and a pair that is there twice."""
    rng = random.Random(seed)
    shapes = [[(k, k + 1) for k in range(3)], [(0, 1), (1, 2), (2, 0), (2, 3)], [(0, 1), (0, 1)]]
    return [(100 * s + a, 100 * s + b, rng.gauss(0, 2), rng.uniform(0.1, 3)) for s, shape in enumerate(shapes) for a, b in shape]


def dense(pairs, ridge):
    nodes = sorted({x for a, b, *_ in pairs for x in (a, b)})
    at = {n: k for k, n in enumerate(nodes)}
    rows, y = [], []
    for a, b, d, w in pairs:
        r = np.zeros(len(nodes))
        r[at[b]], r[at[a]] = math.sqrt(w), -math.sqrt(w)
        rows.append(r)
        y.append(math.sqrt(w) * d)
    m = np.vstack([np.array(rows), math.sqrt(ridge) * np.eye(len(nodes))])
    x = np.linalg.lstsq(m, np.concatenate([y, np.zeros(len(nodes))]), rcond=None)[0]
    return dict(zip(nodes, x)), np.linalg.norm(m @ x - np.concatenate([y, np.zeros(len(nodes))]))


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_equals_a_dense_solve(spark, ridge):
    pairs = a_graph(3)
    want, norm = dense(pairs, ridge)
    df = spark.createDataFrame(pairs, "a long, b long, d double, w double").repartition(3)
    got = {r.node: r.x for r in alignment.least_squares(df, ridge, 1e-7).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-5 for n in want)
    residual = math.sqrt(sum(w * (got[b] - got[a] - d) ** 2 for a, b, d, w in pairs) + ridge * sum(x * x for x in got.values()))
    assert math.isclose(residual, norm, rel_tol=1e-8)
    if not ridge:
        assert all(abs(sum(x for n, x in got.items() if n // 100 == s)) < 1e-8 for s in range(3))


def test_no_shifts_and_no_convergence(spark):
    still = spark.createDataFrame([(1, 2, 0.0, 1.0), (2, 3, 0.0, 1.0)], "a long, b long, d double, w double")
    assert {r.x for r in alignment.least_squares(still).collect()} == {0.0}
    assert not alignment.least_squares(still.where("false")).collect()
    with pytest.raises(ValueError):
        alignment.least_squares(spark.createDataFrame(a_graph(1), still.schema), most_rounds=2)


def test_late_waveforms_are_moved(spark):
    rng = np.random.default_rng(5)
    base, lags = np.convolve(rng.normal(size=90), np.ones(4), "valid")[:80], [0, 3, -2, 1, 0]
    rows = [(k, "A", 10.0 + 0.01 * k, 20.0, 2.0, [float(x) for x in np.roll(base, lag)[10:70]]) for k, lag in enumerate(lags)]
    rows += [(9, "A", 60.0, 20.0, 2.0, rows[0][5]), (8, "B", 10.0, 20.0, 2.0, rows[1][5])]  # far away, and at another station
    windows = spark.createDataFrame(rows, "node long, sta string, lon double, lat double, srate double, samples array<double>")
    arrivals = spark.createDataFrame([(r[0], 100.0) for r in rows], "node long, atime double")
    got = {r.node: r.atime - 100 for r in alignment.aligned(windows, arrivals, km=15.0, most=6, least_xc=0.5, prior_seconds=1e3).collect()}
    mean = np.mean(lags) / 2
    assert all(abs(got[k] - (lag / 2 - mean)) < 0.05 for k, lag in enumerate(lags)) and got[9] == got[8] == 0


def values(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(5):
        mu = 10 + rng.normal() * 3
        for s in range(rng.integers(1, 5)):
            theta = mu + rng.normal() * 1.5
            rows += [(f"r{r}", 10 * r + s, float(theta + rng.normal() * 2)) for _ in range(int(rng.integers(1, 7)))]
    return rows + [("r0", 0, None)]


def log_likelihood(rows, v):
    """Of all values with a flat prior of the global mean, by their joint covariance."""
    rows = [r for r in rows if r[2] is not None]
    region, sta, y = (np.array(c) for c in zip(*rows))
    c = v["value"] * np.eye(len(y)) + v["station"] * (sta[:, None] == sta) + v["region"] * (region[:, None] == region)
    inverse, one = np.linalg.inv(c), np.ones(len(y))
    g = one @ inverse @ y / (one @ inverse @ one)
    return -0.5 * (np.linalg.slogdet(c)[1] + (y - g) @ inverse @ (y - g) + math.log(one @ inverse @ one)), g, inverse, y, region, sta


def test_pooling_equals_the_joint_normal(spark):
    rows = values(2)
    df = spark.createDataFrame(rows, "region string, sta long, x double").repartition(3)
    got, v = hierarchy.pooled_tree(df, "region", "sta", "x", tolerance=5e-3)
    got = got.collect()
    top, g, inverse, y, region, sta = log_likelihood(rows, v)
    for r in got:
        assert math.isclose(r.global_mean, g, rel_tol=1e-9)
        both = v["station"] * (sta == r.sta) + v["region"] * (region == r.region)
        assert math.isclose(r.pooled, g + both @ inverse @ (y - g), rel_tol=1e-7)
        assert math.isclose(r.region_mean, g + v["region"] * (region == r.region) @ inverse @ (y - g), rel_tol=1e-7)
    for name in v:  # the variances are where the likelihood is greatest
        assert all(log_likelihood(rows, v | {name: v[name] * f})[0] < top for f in (0.6, 1.7))


def test_rounds_never_lose_likelihood(spark):
    rows = values(7)
    df = spark.createDataFrame(rows, "region string, sta long, x double")
    steps = [log_likelihood(rows, hierarchy.pooled_tree(df, "region", "sta", "x", rounds=k)[1])[0] for k in (1, 3)]
    assert steps == sorted(steps)


def test_pooling_of_little(spark):
    one = spark.createDataFrame([("a", 1, 5.0)], "region string, sta long, x double")
    r = hierarchy.pooled_tree(one, "region", "sta", "x", rounds=3)[0].first()
    assert (r.n, r.pooled, r.global_mean) == (1, 5.0, 5.0)
    assert not hierarchy.pooled_tree(one.where("false"), "region", "sta", "x")[0].collect()
