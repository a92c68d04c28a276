"""Exact marginals of components with loops, of more pairs than can be listed state by state."""

import math
import random

import pandas as pd

from tests.test_inference import enumerated
from tremorlake.operators import association


def _band(rng, n, base):
    """Arrivals beside the templates of nearly their own time: a chain of loops."""
    return [(base + i, base + g, rng.gauss(0, 3)) for i in range(n) for g in (i - 1, i, i + 1) if 0 <= g < n]


def test_long_loops_are_exact(spark):
    rng = random.Random(9)
    small = _band(rng, 6, 0) + [(0, 5, 1.0), (5, 0, -2.0)]
    assert len(small) == 18  # more than 16
    full = [(100 + i, 100 + g, rng.gauss(-1, 2)) for i in range(4) for g in range(5)]
    long = _band(rng, 40, 1000)
    df = spark.createDataFrame(small + full + long, "id long, gid long, log_odds double").repartition(3)
    got = {(r.id, r.gid): r.p for r in association.marginals(df).collect()}
    want = enumerated(small) | enumerated(full)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-15) for k in want)
    # of a tridiagonal table all choices sum up by rows: the state is which of two templates are taken
    w = {(i, g): math.exp(s) for i, g, s in long}
    def total(skip):
        now = {(False, False): 1.0}  # templates i - 1 and i taken
        for i in range(1000, 1040):
            after = {}
            for (a, b), v in now.items():
                ways = [((b, False), v)]
                if i != skip[0]:
                    ways += [((b, False), v * w[i, i - 1])] if (i, i - 1) in w and not a and i - 1 != skip[1] else []
                    ways += [((True, False), v * w[i, i])] if not b and i != skip[1] else []
                    ways += [((b, True), v * w[i, i + 1])] if (i, i + 1) in w and i + 1 != skip[1] else []
                for k, x in ways:
                    after[k] = after.get(k, 0.0) + x
            now = after
        return sum(now.values())
    z = total((None, None))
    assert all(math.isclose(got[k], x * total(k) / z, rel_tol=1e-9) for k, x in w.items())


def test_too_many_states_are_left_to_messages(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(i, g, rng.gauss(-1, 1)) for i in range(5) for g in range(5)]
    monkeypatch.setattr(association, "MOST_STATES", 8)
    part = pd.DataFrame(pairs, columns=["id", "gid", "log_odds"])
    assert association._summed(part)["p"].isna().all()
