"""Votes counted by periods of time: rows of detections are shuffled, not their votes, and rivals of one station and phase are settled."""

import math

from tests.test_proposals import RATE, STATIONS, STEP, TICK, catalogue, km
from tremorlake.operators import models, proposals, votes


def _picks(spark):
    # pairs of one station and phase a few seconds apart, over the borders of periods
    times = [votes.bins_in_period(TICK, 8.0) * TICK * k + d for k in range(3) for d in (-12.0, 0.5, 3.0, 9.5, 700.0)]
    rows = [(s, p, t) for s, _, _ in STATIONS[:4] for p in ("P", "S") for t in times]
    return spark.createDataFrame(rows, "sta long, phase string, atime double"), spark.createDataFrame(STATIONS[:4], "sta long, slon double, slat double"), rows


def test_grid_of_rivals_against_a_plain_form(spark):
    templates, stations, rows = _picks(spark)
    where = {s: (lon, lat) for s, lon, lat in STATIONS}
    cdf = lambda z: 0.5 * math.exp(z / 5) if z < 0 else 1 - 0.5 * math.exp(-z / 5)
    best = {}
    for cell in range(72):
        for s, p, t in rows:
            t0 = t - km(cell % 12 * 30 - 165, cell // 12 * 30 - 75, *where[s]) / 8
            for b in range(math.floor(t0 / 10) - 1, math.floor(t0 / 10) + 2):
                m = cdf((b + 1) * 10 - t0) - cdf(b * 10 - t0)
                if m > 10 * math.exp(-8):
                    best[cell, b, s, p] = max(m, best.get((cell, b, s, p), 0))
    want = {}
    for (cell, b, *_), m in best.items():
        score, n = want.get((cell, b), (0.0, 0))
        want[cell, b] = score + math.log(m / 10) + 8, n + 1
    got = models.event_grid(templates, stations, STEP, STEP, TICK).collect()
    assert len(got) == len(want) and {(r.cell, r.tbin) for r in got} == set(want)
    for r in got:
        assert r.n == want[r.cell, r.tbin][1] and math.isclose(r.score, want[r.cell, r.tbin][0], rel_tol=1e-9)


def test_no_votes_are_shuffled(spark):
    templates, stations = catalogue(spark, [(-15.0, 15.0, 5005.0), (105.0, -45.0, 20005.0)])
    assert votes.dealt(templates, stations, TICK, 8.0).count() <= 2 * templates.count()
    grid = models.event_grid(templates, stations, STEP, STEP, TICK)
    top = proposals.local_maxima(proposals.with_probabilities(grid, STEP, STEP, TICK, RATE), STEP, STEP, 0.0)
    for df in (grid, top, proposals.refined(top, templates, stations, STEP, STEP, TICK)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange" in x]
        # by a place and a bin: that is dealing votes, or each row to all that are beside it
        assert dealt and not any("hashpartitioning(cell" in x or "hashpartitioning(_b" in x for x in dealt)
