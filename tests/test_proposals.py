"""Grid probabilities, local maxima and finer grids against plain forms, with planted events."""

import math

import numpy as np

from tremorlake.operators import models, proposals

STEP, TICK, RATE = 30.0, 10.0, 0.001
STATIONS = [(k, float(k * 67 % 360 - 180), float(k * 29 % 160 - 80)) for k in range(12)]


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * math.asin(math.sqrt(min(1, math.sin((b - d) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((a - c) / 2) ** 2))) * 6371


def catalogue(spark, events):
    """Every station sees each event, exactly on time."""
    picks = [(s, "P", t + km(lon, lat, slon, slat) / 8) for lon, lat, t in events for s, slon, slat in STATIONS]
    return spark.createDataFrame(picks, "sta long, phase string, atime double"), spark.createDataFrame(STATIONS, "sta long, slon double, slat double")


def test_probabilities(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), float(s), 1) for (c, t), s in zip(((c, t) for c in range(0, 72, 5) for t in range(100, 110, 3)), rng.normal(0, 6, 60))]
    grid = spark.createDataFrame(rows, "cell long, tbin long, score double, n long")
    prior = {c: RATE * TICK * (math.sin(math.radians(c // 12 * 30 - 60)) - math.sin(math.radians(c // 12 * 30 - 90))) / 24 for c in range(72)}
    assert abs(sum(prior.values()) - RATE * TICK) < 1e-12
    score = {(c, t): s for c, t, s, _ in rows}
    # all bins from the first to the last, listed or not
    mass = {(c, t): prior[c] * math.exp(score.get((c, t), 0.0)) for c in range(72) for t in range(100, 110)}
    got = {(r.cell, r.tbin): r for r in proposals.with_probabilities(grid, STEP, STEP, TICK, RATE).collect()}
    assert len(got) == len(rows)
    for at, r in got.items():
        p = prior[at[0]] * math.exp(score[at])
        assert math.isclose(r.p_bin, p / (p + 1 - prior[at[0]]), rel_tol=1e-9)
        assert math.isclose(r.p_one, mass[at] / sum(mass.values()), rel_tol=1e-9)
    many = spark.createDataFrame([(0, 1, 5000.0, 900), (1, 1, 4000.0, 700), (2, 1, None, 0)], "cell long, tbin long, score double, n long")
    top = {r.cell: r.p_one for r in proposals.with_probabilities(many, STEP, STEP, TICK, RATE).collect()}
    assert set(top) == {0, 1} and abs(top[0] - 1) < 1e-9
    assert not proposals.with_probabilities(grid.where("false"), STEP, STEP, TICK, RATE).collect()


def test_local_maxima(spark):
    rng = np.random.default_rng(6)
    odds = {(int(c), int(t)): float(s) for c, t, s in zip(rng.integers(0, 72, 400), rng.integers(0, 12, 400), rng.integers(-3, 6, 400))}
    grid = spark.createDataFrame([(c, t, s) for (c, t), s in odds.items()], "cell long, tbin long, odds double")
    for reach in (0, 1, 2):
        want = set()
        for (c, t), s in odds.items():
            beside = [(o, -a, -b) for (a, b), o in odds.items() if abs(b - t) <= reach and abs(a // 12 - c // 12) <= 1 and (a - c) % 12 in (0, 1, 11)]
            if s >= 0 and max(beside) == (s, -c, -t):
                want.add((c, t))
        assert {(r.cell, r.tbin) for r in proposals.local_maxima(grid, STEP, STEP, 0.0, reach).collect()} == want
    # the date line is no border
    line = spark.createDataFrame([(0, 1, 2.0), (11, 1, 3.0)], "cell long, tbin long, odds double")
    assert [r.cell for r in proposals.local_maxima(line, STEP, STEP, 0.0).collect()] == [11]


def test_planted_events_are_proposed_and_refined(spark):
    # events at the middle of coarse cells, so that the coarse grid sees them, and one on a finer place's middle beside the date line
    events = [(-15.0, 15.0, 5005.0), (105.0, -45.0, 20005.0), (165.0, 45.0, 40005.0)]
    templates, stations = catalogue(spark, events)
    grid = proposals.with_probabilities(models.event_grid(templates, stations, STEP, STEP, TICK), STEP, STEP, TICK, RATE)
    top = proposals.local_maxima(grid, STEP, STEP, 20.0)
    got = proposals.refined(top, templates, stations, STEP, STEP, TICK).collect()
    for lon, lat, t in events:
        near = [r for r in got if km(lon, lat, r.lon, r.lat) < 1 and abs(r.time - t) <= 5]
        assert near and max(r.p for r in near) > 0.4
    assert not proposals.refined(top.where("false"), templates, stations, STEP, STEP, TICK).collect()
    assert not proposals.refined(top, templates.where("false"), stations, STEP, STEP, TICK).collect()


def test_refined_against_a_plain_form(spark):
    rng = np.random.default_rng(7)
    templates, stations = catalogue(spark, [(float(rng.uniform(-180, 180)), float(rng.uniform(-80, 80)), float(rng.uniform(0, 3000))) for _ in range(6)])
    wanted = [(int(c), int(t)) for c, t in zip(rng.integers(0, 72, 5), rng.integers(0, 300, 5))]
    top = spark.createDataFrame(wanted, "cell long, tbin long")
    got = {(r.cell, r.tbin): r for r in proposals.refined(top, templates, stations, STEP, STEP, TICK, fan=3).collect()}
    where = {s: (lon, lat) for s, lon, lat in STATIONS}
    cdf = lambda z: 0.5 * math.exp(z / 5) if z < 0 else 1 - 0.5 * math.exp(-z / 5)
    picks = templates.collect()
    for cell, tbin in set(wanted):
        scores = {}
        for child in range(9):
            lon, lat = cell % 12 * 30 - 180 + (child % 3 + 0.5) * 10, cell // 12 * 30 - 90 + (child // 3 + 0.5) * 10
            best = {}
            for r in picks:
                t0 = r.atime - km(lon, lat, *where[r.sta]) / 8
                for f in range(math.floor(t0 / 5) - 1, math.floor(t0 / 5) + 2):
                    m = cdf((f + 1) * 5 - t0) - cdf(f * 5 - t0)
                    if tbin * 2 - 2 <= f <= tbin * 2 + 3 and m > 5 * math.exp(-8):
                        best[f, r.sta, r.phase] = max(m, best.get((f, r.sta, r.phase), 0))
            for (f, *_), m in best.items():
                scores[child, f] = scores.get((child, f), 0) + math.log(m / 5) + 8
        if not scores:
            assert (cell, tbin) not in got
            continue
        most = max(scores.values())
        r = got[cell, tbin]
        assert math.isclose(r.fine_score, most, rel_tol=1e-9)
        total = sum(math.exp(s - most) for s in scores.values()) + (54 - len(scores)) * math.exp(-most)
        assert math.isclose(r.p, 1 / total, rel_tol=1e-9)
