"""Regression by neighbours and kernels against plain forms, with ties, nulls, repeated rows and a place that holds most rows."""

import math

import numpy as np
import pytest

from tremorlake.operators import smoothing

SCHEMA = "x double, y double"


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    some = [(float(x), float(y)) for x, y in zip(rng.integers(0, 40, 150), rng.integers(0, 9, 150))]
    hot = [(17.0, float(y)) for y in rng.integers(0, 1000, 200)]
    return some + hot + [(-500.0, 1.0), (1e6, 2.0)] + [(None, 3.0), (4.0, None)]


def queries_of():
    return [(k, q) for k, q in enumerate([-1e9, -500.0, -3.0, 0.0, 0.5, 16.9, 17.0, 17.5, 18.0, 39.0, 41.0, 5e5, 1e6, 2e6])]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_nearest(spark, k):
    rows, queries = rows_of(), queries_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    q = spark.createDataFrame([*queries, (99, None)], "qid int, qx double")
    got = {}
    for r in smoothing.nearest(df, q, "x", "qx", "y", k).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.x, r.y))
    want = {}
    for i, at in queries:
        order = sorted((abs(x - at), x, y) for x, y in rows if x is not None and y is not None)
        want[i] = [(n + 1, x, y) for n, (_, x, y) in enumerate(order[:k])]
    assert {i: sorted(v) for i, v in got.items()} == want


def test_few_rows_and_none(spark):
    q = spark.createDataFrame([(1, 0.0)], "qid int, qx double")
    two = spark.createDataFrame([(5.0, 1.0), (6.0, 3.0)], SCHEMA)
    r = smoothing.neighbour_regression(two, q, "x", "qx", "y", 5).first()
    assert (r.value, r.n) == (2.0, 2)
    assert not smoothing.neighbour_regression(two.where("false"), q, "x", "qx", "y", 5).collect()
    assert not smoothing.kernel_regression(two.where("false"), q, "x", "qx", "y").collect()
    assert not smoothing.kernel_regression(two, q.where("false"), "x", "qx", "y").collect()
    assert smoothing.kernel_regression(two.where("x = 5"), q, "x", "qx", "y").first().value == 1.0  # a single place has a width of 1


@pytest.mark.parametrize("width", [None, 2.5])
def test_kernels(spark, width):
    rows, queries = rows_of(1), queries_of()
    places = {}
    for x, y in rows:
        if x is not None and y is not None:
            places.setdefault(x, []).append(y)
    wide = {x: width or np.mean(sorted(abs(x - o) for o in places)[:3]) for x in places}
    want = {}
    for i, at in queries:
        hit = [(len(ys) * math.exp(-0.5 * ((x - at) / wide[x]) ** 2) / math.sqrt(wide[x]), np.mean(ys)) for x, ys in places.items() if abs(x - at) <= 9 * wide[x]]
        if hit:
            want[i] = sum(w * y for w, y in hit) / sum(w for w, _ in hit)
    df, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*queries, (99, None)], "qid int, qx double")
    got = {r.qid: r.value for r in smoothing.kernel_regression(df, q, "x", "qx", "y", width).collect()}
    assert got.keys() == want.keys() and 3 < len(got)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
