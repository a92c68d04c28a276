"""Golden values and brute force for what SQL can't express."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import geo, waves
from tremorlake.operators import graphs, joins, matching, models, sequences, series


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_geodesics(spark):
    assert int(value(spark, geo.dist_deg(10, 0, 20, 0)) + 1e-9) == 10
    # fixed values: distances, angles and directions that any such functions have to give
    assert int(value(spark, geo.dist_deg(10, 0, 10, 45)) + 1e-9) == 45
    assert int(value(spark, geo.dist_deg(-78, -12, -10.25, 52))) == 86
    assert value(spark, geo.dist_deg(132.86521, -0.45606493, 132.86521, -0.45606493)) < 1e-4
    for a, b, d in ((40, 30, -10), (30, 40, 10), (361, 40, 39), (40, 361, -39), (40, 250, -150), (40, 200, 160), (40, 219, 179), (40, 220, 180), (40, 221, -179)):
        assert value(spark, geo.degdiff(a, b)) == d
    assert int(value(spark, geo.azimuth(10, 0, 20, 0)) + 1e-6) == 90
    assert int(value(spark, geo.azimuth(20, 0, 10, 0)) + 1e-6) == 270
    assert value(spark, geo.azimuth(10, 45, 10, 0)) == 180.0
    assert int(value(spark, geo.azimuth(133.9, -23.665, 132.6, -0.83))) == 356


def test_masks():
    mask = np.zeros(30, bool)
    mask[[0, 1, 2, 9, 10, 11, 12, 13, 14, 29]] = True
    assert waves.mask_blocks(mask) == [(0, 3), (9, 15), (29, 30)]
    assert waves.mask_blocks(waves.grow_mask(mask, 2)) == [(0, 5), (7, 17), (27, 30)]
    assert waves.mask_blocks(~mask | mask) == [(0, 30)] and not waves.mask_blocks(np.zeros(4, bool))


def filled(n, gaps):
    x = np.arange(float(n))
    for a, b in gaps:
        x[a:b] = np.nan
    return waves.mirror_missing(x).tolist()


def test_mirrored_gaps():
    assert filled(12, [(4, 7)]) == [0, 1, 2, 3, 3, 8, 7, 7, 8, 9, 10, 11]  # one from the left, two from the right
    assert filled(12, [(1, 7)]) == [0, 0, 11, 10, 9, 8, 7, 7, 8, 9, 10, 11]  # the left side is short, the right one fills what it leaves
    assert filled(12, [(5, 11)]) == [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 11, 11]  # and the other way round
    assert filled(6, [(0, 2)]) == [3, 2, 2, 3, 4, 5] and filled(6, [(4, 6)]) == [0, 1, 2, 3, 3, 2]
    mean = (0 + 5 + 6) / 3  # both sides are short
    assert filled(7, [(1, 5)]) == [0, 0, mean, 6, 5, 5, 6]
    # two gaps beside each other: what one is filled with is nothing that the other could reflect
    got = filled(14, [(2, 4), (5, 9)])
    assert got == [0, 1, 1, 4, 4, 4, 11, 10, 9, 9, 10, 11, 12, 13]
    assert waves.mirror_missing(np.full(3, np.nan)).tolist() == [0, 0, 0]


def test_filter_chain():
    t = np.arange(1000) / 10
    x = np.sin(2 * np.pi * 2.5 * t) + np.sin(2 * np.pi * 0.2 * t)
    y, rate = waves.apply_chain(x, 10.0, "freq_2.0_3.0")
    assert np.abs(y[200:800] - np.sin(2 * np.pi * 2.5 * t)[200:800]).max() < 0.05
    env, _ = waves.apply_chain(x, 10.0, "freq_2.0_3.0;env")
    assert np.abs(env[200:800] - 1).max() < 0.1
    z, rate = waves.apply_chain(x, 10.0, "freq_2.0_3.0;env;smooth_5;hz_5")
    assert rate == 5 and len(z) == 500
    same = [waves.apply_chain(x, 10.0, c, canonical=True)[0] for c in ("freq_2.0_3.0;env;smooth", "env;freq_2.0_3.0;smooth")]
    assert np.array_equal(*same) and not np.allclose(same[0], waves.apply_chain(x, 10.0, "env;smooth", canonical=True)[0])
    with pytest.raises(ValueError):
        waves.apply_chain(x, 10.0, "hz_3")
    with pytest.raises(ValueError):
        waves.parse_chain("env;env", canonical=True)


def test_binary_samples():
    values = [-(2**23), -1, 0, 1, 2**23 - 1]
    raw = b"".join((v & 0xFFFFFF).to_bytes(3, "big") for v in values)
    assert waves.decode_samples(raw, "s3").tolist() == values
    values = [-(2**31), -1, 0, 2**31 - 1]
    assert waves.decode_samples(b"".join(v.to_bytes(4, "big", signed=True) for v in values), "s4", 2.0).tolist() == [2.0 * v for v in values]


def test_ar_model():
    rng = np.random.default_rng(0)
    x = np.zeros(3000)
    for i in range(2, 3000):
        x[i] = 0.8 * x[i - 1] + 0.1 * x[i - 2] + 0.11 * rng.normal()
    x = x[1000:] + 3
    phi, sigma = waves.yule_walker(x, 2)
    assert np.allclose(phi, (0.8, 0.1), atol=0.1) and abs(sigma - 0.11) < 0.01
    exact, fast = waves.ar_log_likelihood(x, 3.0, phi, sigma), waves.ar_fast_log_likelihood(x, 3.0, phi, sigma)
    assert abs(exact - fast) < 10
    gap = x.copy()
    gap[500:700] = np.nan
    cov = waves._stationary(np.array([[phi[0], phi[1]], [1, 0]]), sigma)
    assert np.isclose(waves.ar_log_likelihood(gap[:2], 3.0, phi, sigma), -0.5 * np.linalg.solve(cov, gap[:2] - 3) @ (gap[:2] - 3) - 0.5 * np.log(np.linalg.det(2 * np.pi * cov)))
    assert waves.ar_log_likelihood(gap, 3.0, phi, sigma) < exact


def test_best_assignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        edges = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.5]
        if not edges:
            continue
        left, right = (np.array(x) for x in zip(*edges))
        cost = rng.integers(0, 9, len(edges)).astype(float)
        got = matching.best_assignment(left, right, cost)
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for pick in itertools.combinations(range(len(edges)), k):
                if len({left[e] for e in pick}) == k == len({right[e] for e in pick}):
                    best = max(best, (k, -float(cost[list(pick)].sum())))
        assert len({left[e] for e in got}) == len(got) == len({right[e] for e in got})
        assert (len(got), -float(cost[got].sum())) == best


def test_precision_of_nothing(spark):
    none = spark.createDataFrame([], "id long, t double, lon double, lat double, d double, gid long")
    some = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, t double, lon double, lat double")
    assert matching.precision_recall(none, some, none).first()[:3] == (0.0, 100.0, 0.0)
    assert matching.precision_recall(some, none, none).first()[:3] == (100.0, 0.0, 0.0)


def events(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, float(rng.integers(0, 3000)), float(rng.integers(0, 8)), float(rng.integers(0, 8)), float(rng.integers(0, 6))) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_suppression_in_islands_equals_one_pass(spark, seed):
    rows = events(120, seed)
    df = spark.createDataFrame(rows, "id long, t double, lon double, lat double, score double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    gone = set()
    for i, a in enumerate(order):
        if a[0] in gone:
            continue
        for b in order[i + 1 :]:
            if b[1] - a[1] > 50:
                break
            if sequences._degrees(a[2:4], b[2:4]) < 5:
                if a[4] > b[4]:
                    gone.add(b[0])
                else:
                    gone.add(a[0])
                    break
    assert {r.id for r in sequences.suppress_in_order(df).collect()} == {r[0] for r in rows} - gone


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(x)) for i, x in enumerate(rng.integers(-50, 50, 60))]
    b = [(i, float(x)) for i, x in enumerate(rng.integers(-50, 50, 60))]
    left, right = spark.createDataFrame(a, "i long, x double"), spark.createDataFrame(b, "j long, y double")
    got = joins.band_join(left, right, "x", "y", 3.0).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, x in a for j, y in b if abs(x - y) <= 3)
    anti = joins.band_join(left, right, "x", "y", 1.0, how="left_anti").collect()
    assert {r.i for r in anti} == {i for i, x in a if not any(abs(x - y) <= 1 for _, y in b)}
    spans = lambda rows, s, e, k: spark.createDataFrame([(i, x, x + i % 20) for i, x in rows], f"{k} long, {s} double, {e} double")
    got = joins.overlap_join(spans(a, "s", "e", "i"), spans(b, "u", "v", "j"), ("s", "e"), ("u", "v"), 7.0).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, x in a for j, y in b if x <= y + j % 20 and y <= x + i % 20)


def test_global_ordinal(spark):
    rows = [(i, float(i * 7919 % 101)) for i in range(200)]
    got = sequences.ordinal(spark.createDataFrame(rows, "id long, t double").repartition(5), [], ["t", "id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.ordinal)] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r.ordinal for r in got) == list(range(200))


def test_stitching(spark):
    schema = "sta string, chan string, time double, srate double, samples array<double>"
    files = spark.createDataFrame([("A", "Z", 0.0, 1.0, [1.0] * 10), ("A", "Z", 8.0, 1.0, [2.0] * 6), ("A", "Z", 30.0, 1.0, [3.0] * 5)], schema)
    req = spark.createDataFrame([(1, "A", "Z", 5.0, 20.0)], "rid long, sta string, chan string, stime double, etime double")
    assert series.stitched(req, files).first()["samples"] == [1.0] * 3 + [2.0] * 6 + [None] * 6
    assert series.stitched(req, files, 2.0, mirror=True).first()["samples"] == [None, None, 1.0] + [2.0] * 6 + [2.0] * 4 + [None] * 2
    # a file of a multiple of the least rate is decimated, any other rate is an error
    fast = spark.createDataFrame([("A", "Z", 14.0, 4.0, [5.0] * 24)], schema)
    got = series.stitched(req, files.unionByName(fast)).first()
    assert got["srate"] == 1.0 and got["samples"][:9] == [1.0] * 3 + [2.0] * 6 and np.allclose(got["samples"][9:], 5.0)
    odd = spark.createDataFrame([("A", "Z", 14.0, 2.5, [5.0] * 24)], schema)
    with pytest.raises(Exception, match="no multiple"):
        series.stitched(req, files.unionByName(odd)).collect()


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_long_chains_and_hubs(spark, few, monkeypatch):
    monkeypatch.setattr(graphs, "HUB", 3)
    chain = [(k, k + 1) for k in range(100, 180)]
    star = [(7, k) for k in range(300, 330)] + [(5, 5)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(chain + star, "a long, b long"), few=few).collect()}
    assert got == {k: 100 for k in range(100, 181)} | {k: 7 for k in (7, *range(300, 330))} | {5: 5}


def test_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 4)], "parent long, child long")
    assert {r.id: r.level for r in graphs.levels(edges).collect()} == {1: 0, 9: 0, 2: 1, 3: 2, 4: 3}
    with pytest.raises(ValueError):
        graphs.levels(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long"))


def test_matching_against_all_assignments(spark):
    rng = np.random.default_rng(5)
    gold = [(i, float(rng.integers(0, 600)), float(rng.integers(0, 3)), 0.0) for i in range(14)]
    guess = [(i, float(rng.integers(0, 600)), float(rng.integers(0, 3)), 0.0) for i in range(14)]
    names = "id long, t double, lon double, lat double"
    got = matching.matched(spark.createDataFrame(gold, names), spark.createDataFrame(guess, names), 50.0, 1.0).collect()
    edges = [(a[0], b[0], abs(a[2] - b[2])) for a in gold for b in guess if abs(a[1] - b[1]) <= 50 and abs(a[2] - b[2]) <= 1]
    best = {}  # guesses that are taken -> most pairs and least distance, gold after gold
    best[frozenset()] = (0, 0.0)
    for a in gold:
        for used, (k, d) in list(best.items()):
            for _, b, far in (e for e in edges if e[0] == a[0]):
                if b not in used:
                    new = used | {b}
                    best[new] = max(best.get(new, (0, 0.0)), (k + 1, d - far))
    assert len({r.id for r in got}) == len(got) == len({r.gid for r in got}) and all((r.id, r.gid, round(r.d)) in {(a, b, round(d)) for a, b, d in edges} for r in got)
    k, d = max(best.values())
    assert len(got) == k and abs(sum(r.d for r in got) + d) < 1e-6


def test_running_sums(spark):
    rows = [(i, i * 7919 % 101) for i in range(101)]
    got = sequences.running_sums(spark.createDataFrame(rows, "x long, y long").repartition(4), ["y"], {"s": "x", "k": "y"}, descending=True).collect()
    by = sorted(rows, key=lambda r: -r[1])
    want = {y: (sum(r[0] for r in by[: i + 1]), sum(r[1] for r in by[: i + 1])) for i, (x, y) in enumerate(by)}
    assert {r.y: (r.s, r.k) for r in got} == want


def test_location(spark):
    stations = [(0.0, 0.0), (20.0, 5.0), (10.0, 30.0), (-15.0, 20.0), (5.0, -25.0)]
    truth, t0 = (8.0, 9.0), 100.0
    rows = []
    for lon, lat in stations:
        d = math.radians(sequences._degrees(truth, (lon, lat))) * geo.EARTH_RADIUS_KM
        rows.append((1, lon, lat, t0 + d / 8.0))
    got = models.located(spark.createDataFrame(rows, "evid long, slon double, slat double, atime double")).first()
    assert abs(got.lon - 8) < 0.01 and abs(got.lat - 9) < 0.01 and abs(got.t0 - 100) < 0.1


def test_sampler_recovers_rate(spark):
    got = models.run_blocks(spark.createDataFrame([(1, 0, 400, 1000.0)], "block long, seed int, n long, seconds double")).first()
    assert abs(got.rate - 0.4) < 0.05 and 0.1 < got.accepted < 0.9
