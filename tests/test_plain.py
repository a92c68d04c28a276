"""Operators whose queries have no SQL, against plain forms."""

import itertools
import math
import struct

import numpy as np
import pandas as pd
import pytest

from tremorlake.functions import waves
from tremorlake.operators import catalogue, matching, models, sequences, series, training
from tremorlake.sources import bulletins


def test_greedy_coverage(spark):
    rng = np.random.default_rng(0)
    seen = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 12, 150), rng.integers(0, 40, 150))})
    got = [tuple(r) for r in catalogue.greedy_coverage(spark.createDataFrame(seen, "sta long, evid long"), 6, times=2).orderBy("rank").collect()]
    count, chosen = dict.fromkeys(range(40), 0), []
    for rank in range(6):
        gain = {s: sum(count[e] < 2 for t, e in seen if t == s) for s, _ in seen if s not in [c[1] for c in chosen]}
        best = min(gain, key=lambda s: (-gain[s], s))
        chosen.append((rank, best, gain[best]))
        for s, e in seen:
            count[e] += s == best
    assert got == chosen


def test_samples_and_folds(spark):
    rows = spark.range(500).toDF("id")
    one, two = ({r.id for r in catalogue.sample_rows(d, "id", 60, seed=3).collect()} for d in (rows, rows.repartition(7)))
    assert one == two and len(one) == 60 and one != {r.id for r in catalogue.sample_rows(rows, "id", 60, seed=4).collect()}
    fold = {r.id: r.fold for r in sequences.folds(rows, "id", 5).collect()}
    assert len(fold) == 500 and set(fold.values()) == set(range(5)) and min(np.bincount(list(fold.values()))) > 60


@pytest.mark.parametrize("seed", [3, 4])
def test_fixpoint_suppression(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, 1500)), float(rng.integers(0, 12)) / 10, float(rng.integers(0, 12)) / 10, float(rng.integers(0, 5))) for i in range(120)]
    live, changed = sorted(rows, key=lambda r: (r[1], r[0])), True
    while changed:
        changed, i = False, 0
        while i < len(live):
            a = live[i]
            near = next((b for b in live[i + 1 :] if b[1] - a[1] <= 50 and math.radians(sequences._degrees(a[2:4], b[2:4])) * 6371 <= 60), None)
            if near is not None:
                changed = True
                gone = a if near[4] > a[4] else near
                live.remove(gone)
                i += gone is not a
            else:
                i += 1
    got = sequences.suppress_to_fixpoint(spark.createDataFrame(rows, "id long, t double, lon double, lat double, score double"))
    assert {r.id for r in got.collect()} == {r[0] for r in live}


def test_fits(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"id": np.arange(300), "g": np.arange(300) % 3, "x": rng.integers(0, 40, 300).astype(float)})
    rows["y"] = rows["g"] * 2 + 0.5 * rows["x"] + rng.normal(size=300) + np.where(np.arange(300) % 37 == 0, 60, 0)
    df = spark.createDataFrame(rows)
    for r in models.robust_line(df, ["g"], "x", "y").collect():
        every = rows[rows["g"] == r.g]
        kept = every
        for _ in range(3):
            slope, intercept = np.polyfit(kept["x"], kept["y"], 1)
            off = every["y"] - slope * every["x"] - intercept
            kept = every[np.abs(off) <= 3 * off.std(ddof=0)]
        # the fit of the last round, before or after its outliers went
        assert min(abs(r.slope - s) for s in (slope, np.polyfit(kept["x"], kept["y"], 1)[0])) < 1e-9
    fold = {r.id: r.fold for r in sequences.folds(df, "id", 5).collect()}
    error = []
    for k in range(5):
        inside = rows[[fold[i] != k for i in rows["id"]]]
        slope, intercept = np.polyfit(inside["x"], inside["y"], 1)
        out = rows[[fold[i] == k for i in rows["id"]]]
        error += np.abs(out["y"] - slope * out["x"] - intercept).tolist()
    got = models.cross_validated(df, "id", "x", "y").first()
    assert abs(got.mean_abs - np.mean(error)) < 1e-9 and abs(got.median_abs - np.median(error)) < 1e-9
    # a process over repeated places is one over all points
    at = [0.0, 10.0, 33.0]
    for g, part in rows.groupby("g"):
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        k = np.exp(-0.5 * ((x[:, None] - x[None, :]) / 8) ** 2) + 4 * np.eye(len(x))
        cross = np.exp(-0.5 * ((x[:, None] - np.array(at)[None, :]) / 8) ** 2)
        mean = y.mean() + cross.T @ np.linalg.solve(k, y - y.mean())
        var = 1 + 4 - (cross * np.linalg.solve(k, cross)).sum(axis=0)
        got = models.gaussian_process(df.where(f"g = {g}"), ["g"], at, "x", "y", 8.0, 2.0).orderBy("at").toPandas()
        assert np.allclose(got["mean"], mean) and np.allclose(got["var"], var)


def test_learned_models(spark):
    rng = np.random.default_rng(2)
    near = [(float(c + rng.normal()), float(rng.normal()), 0.0) for c in (-100, 0, 100) for _ in range(50)]
    got = models.clusters(spark.createDataFrame(near, "lon double, lat double, depth double"), 3).toPandas()
    assert got.groupby("cluster").size().tolist() == [50] * 3 and all(p["lon"].max() - p["lon"].min() < 20 for _, p in got.groupby("cluster"))
    seen = [(float(m), 10.0, float(d), bool(m - d / 20 > 2)) for m, d in zip(rng.uniform(2, 7, 400), rng.uniform(1, 90, 400))]
    df = spark.createDataFrame(seen, "mb double, depth double, dist double, seen boolean")
    w = models.detection_model(df, "seen")
    z = [w["intercept"] + w["mb"] * m + w["exp_mb"] * math.exp(m) / 100 + w["depth"] * z + w["sqrt_depth"] * z**0.5 + w["dist"] * d + w["log_dist"] * math.log1p(d) for m, z, d, _ in seen]
    assert np.mean([(v > 0) == s[3] for v, s in zip(z, seen)]) > 0.95
    assert models.detection_model(df.where("NOT seen"), "seen")["intercept"] == -10.0
    two = spark.createDataFrame([(float(c + rng.normal()),) for c in (0, 20) for _ in range(200)], "x double")
    parts = models.mixture(two, "x", 2, tries=4).toPandas()
    assert np.allclose(parts["mean"], (0, 20), atol=0.5) and np.allclose(parts["weight"], 0.5, atol=0.05)


def test_precision_curve_ends_at_all_guesses(spark):
    guess = spark.createDataFrame([(i, i / 10) for i in range(10)], "id long, score double")
    matches = spark.createDataFrame([(1, 8), (2, 9), (3, 0)], "id long, gid long")
    got = {r.score: (r.n_true, r.n_all, r.recall) for r in matching.curve(guess, matches, 5).collect()}
    assert got[0.9] == (1, 1, 0.2) and got[0.8] == (2, 2, 0.4) and got[0.0] == (3, 10, 0.6)


def test_series_kernels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64)
    template = x[20:36].tolist()
    hits = series.correlations(spark.createDataFrame([(1, x.tolist())], "id long, samples array<double>"), [(7, template)], 0.6).collect()
    t = np.array(template) - np.mean(template)
    want = [k for k in range(49) if t @ x[k : k + 16] / np.linalg.norm(t) / np.linalg.norm(x[k : k + 16]) > 0.6]
    assert [r.lag for r in hits] == want and 20 in want and {r.template for r in hits} == {7}
    y = np.zeros(1200)
    for i in range(2, 1200):
        y[i] = 0.6 * y[i - 1] - 0.5 * y[i - 2] + rng.normal()
    assert waves.ar_order(y, 4) >= 2 and waves.ar_is_stationary(np.array([0.6, -0.5])) and not waves.ar_is_stationary(np.array([1.2]))
    r = waves.ar_autocovariance(np.array([0.6, -0.5]), 1.0, 4)
    assert np.isclose(r[0], 0.6 * r[1] - 0.5 * r[2] + 1) and np.isclose(r[4], 0.6 * r[3] - 0.5 * r[2])
    assert np.allclose(waves.ar_predicted(np.array([1.0, 2.0]), 0.0, np.array([0.6, -0.5]), 2), (0.7, -0.58))
    slow = np.sin(2 * np.pi * 0.05 * np.arange(400) / 10)
    out, rate = waves.decimate(slow, 10.0, 5.0)
    assert rate == 5.0 and np.abs(out[20:-20] - slow[::2][20:-20]).max() < 0.02
    n, f = 400, 1.7
    tone = np.sin(2 * np.pi * f * np.arange(n) / 10)
    assert np.abs(waves.band_pass(tone, 10.0, 1.0, 3.0)[0] - tone)[100:300].max() < 0.05
    assert np.abs(waves.band_pass(tone, 10.0, 3.5, 4.5)[0])[100:300].max() < 0.05


def test_assigned_templates():
    rng = np.random.default_rng(4)
    for _ in range(40):
        phases = {p: float(rng.integers(0, 60)) for p in ("P", "S", "Lg")[: rng.integers(1, 4)]}
        templates = {k: float(rng.integers(0, 60)) for k in range(rng.integers(0, 4))}
        got = training.best_templates(phases, templates)
        score = lambda a: sum(-25.0 if k is None else -abs(templates[k] - phases[p]) for p, k in a.items())
        every = [dict(zip(phases, c)) for c in itertools.product([None, *templates], repeat=len(phases))]
        legal = [a for a in every if len({k for k in a.values() if k is not None}) == sum(k is not None for k in a.values())]
        assert set(got) == set(phases) and score(got) == max(map(score, legal))


def test_sac_headers_and_binary_reads(spark, tmp_path):
    for order in "<>":
        head = bytearray(632)
        struct.pack_into(order + "f", head, 0, 0.05)
        struct.pack_into(order + "f", head, 20, 2.0)
        for at, value in ((280, 2024), (284, 32), (288, 1), (292, 2), (296, 3), (300, 500), (304, 6), (316, 40)):
            struct.pack_into(order + "i", head, at, value)
        head[440:448], head[600:608] = b"ABC     ", b"BHZ     "
        (tmp_path / f"{'le' if order == '<' else 'be'}.sac").write_bytes(bytes(head) + bytes(160))
    (tmp_path / "short.sac").write_bytes(b"none")
    got = bulletins.index_sac_headers(spark, str(tmp_path)).orderBy("path").collect()
    begin = 1704067200 + 31 * 86400 + 3723.5 + 2
    assert [(r.sta, r.chan, r.stime, r.npts) for r in got] == [("ABC", "BHZ", begin, 40)] * 2 and all(abs(r.hz - 20) < 1e-4 and abs(r.etime - begin - 2) < 1e-4 for r in got)
    # a name in two folders is told apart by more of its path
    for k in (1, 2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.w").write_bytes(struct.pack(">3i", k, 10 * k, 100 * k))
    index = spark.createDataFrame([(1, "d1/x.w", 4, 2, "s4", 1.0), (2, "d2/x.w", 0, 1, "s4", 0.5)], "wfid int, dfile string, foff long, nsamp int, datatype string, calib double")
    got = {r.wfid: r.samples for r in bulletins.read_waveforms(spark, index, f"{tmp_path}/d*/*").collect()}
    assert got == {1: [10.0, 100.0], 2: [1.0]}
