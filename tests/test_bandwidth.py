"""Bandwidth likelihoods against brute force on 2000 events."""

import math

import numpy as np
import pytest

from tremorlake.operators import bandwidth


def events(seed, n):
    rng = np.random.default_rng(seed)
    lon = np.concatenate([rng.uniform(-180, 180, n // 2), rng.normal(179, 2, n // 2) % 360 - 180])
    lat = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, n // 2))), rng.normal(10, 2, n // 2)])
    lon[-40:], lat[-40:] = lon[-80:-40], lat[-80:-40]  # repeated places
    return lon, lat


def test_leave_one_out_on_the_sphere(spark):
    lon, lat = events(1, 2000)
    space = bandwidth.Sphere(4.0)
    at = np.stack([lon, lat], axis=1)
    d = np.stack([space.distances(p, at) for p in at])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in at] + [(None, 1.0)], "lon double, lat double").repartition(3)
    widths = [0.5, 2.0, 8.0]
    got = {r.bandwidth: r for r in bandwidth.likelihoods(space, df, widths).collect()}
    for b in widths:
        k = np.exp(-d / b)
        np.fill_diagonal(k, 0)
        want = np.mean(np.log(k.sum(axis=1) / 1999)) - space.log_norm(b)
        assert got[b].n == 2000 and got[b].low - 1e-9 <= want <= got[b].high + 1e-9 and abs(got[b].loglik - want) < 0.05
    exact = bandwidth.likelihoods(space, df, [2.0], near=180.0).first()
    k = np.exp(-d / 2)
    np.fill_diagonal(k, 0)
    assert math.isclose(exact.loglik, np.mean(np.log(k.sum(axis=1) / 1999)) - space.log_norm(2.0), rel_tol=1e-9) and math.isclose(exact.low, exact.high)


def test_norm_is_the_integral_of_the_kernel():
    for b in (0.5, 5.0, 60.0):
        t = np.linspace(0, math.pi, 400_001)
        f = np.exp(-np.degrees(t) / b) * np.sin(t) * 2 * math.pi
        area = ((f[1:] + f[:-1]) / 2).sum() * (t[1] - t[0]) * math.degrees(1) ** 2
        assert math.isclose(math.log(area), bandwidth.Sphere(5.0).log_norm(b), rel_tol=1e-6)


def test_hold_out_on_a_line(spark):
    rng = np.random.default_rng(2)
    x, y = rng.gamma(2, 10, 900), rng.gamma(2, 10, 100)
    frame = lambda v: spark.createDataFrame([(float(a),) for a in v], "x double")
    got = {r.bandwidth: r for r in bandwidth.likelihoods(bandwidth.Line(0.5), frame(x), [0.5, 3.0], frame(y)).collect()}
    for b, r in got.items():
        want = np.mean(np.log(np.maximum(np.exp(-(((y[:, None] - x) / b) ** 2) / 2).mean(axis=1), 1e-300)) - math.log(b * math.sqrt(2 * math.pi)))
        assert r.low - 1e-9 <= want <= r.high + 1e-9 and abs(r.loglik - want) < 0.02
    assert bandwidth.best_bandwidth(bandwidth.Line(0.5), frame(x), [0.01, 3.0], frame(y)) == 3.0


def test_little_data(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert not bandwidth.likelihoods(bandwidth.Line(1.0), one, [1.0]).collect()
    assert not bandwidth.likelihoods(bandwidth.Line(1.0), one.where("false"), [1.0], one).collect()
    with pytest.raises(ValueError):
        bandwidth.Sphere(0.1)
