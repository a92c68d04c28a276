"""Library search, proposals, association odds and their marginals against plain forms."""

import itertools
import math
import random

import numpy as np

from tremorlake.functions import waves
from tremorlake.operators import association, library


def a_library(rng, n, sizes=(40, 64)):
    """Smooth random templates at two stations, some nearly alike."""
    out = []
    for k in range(n):
        size = sizes[k % len(sizes)]
        x = np.convolve(rng.normal(size=size + 8), np.ones(5), "valid")[:size]
        if k % 10 == 9:  # a near copy of an earlier one
            x = np.array(out[-len(sizes)][2]) + 0.3 * x
        out.append((k, f"S{k // 2 % 2}", [float(v) for v in x]))
    return out


def windows_of(rng, templates, n):
    out = []
    for w in range(n):
        x = rng.normal(size=160) * 0.3
        k, sta, t = templates[int(rng.integers(len(templates)))]
        at = int(rng.integers(0, 160 - len(t)))
        x[at : at + len(t)] += np.array(t) * rng.uniform(1, 3)
        out.append((w, sta if w % 5 else "S9", [float(v) for v in x]))
    return out


def all_hits(windows, templates, threshold):
    hits = {}
    for w, sta, x in windows:
        for k, own, t in templates:
            if own == sta:
                xc = waves.sliding_correlation(np.array(t) - np.mean(t), np.array(x))
                hits |= {(w, k, int(i)): float(xc[i]) for i in np.flatnonzero(xc > threshold)}
    return hits


def test_recall_against_every_correlation(spark):
    rng = np.random.default_rng(3)
    templates = a_library(rng, 300)
    windows = windows_of(rng, templates, 80)
    want = all_hits(windows, templates, 0.85)
    t = spark.createDataFrame(templates, "template long, sta string, samples array<double>").repartition(3)
    w = spark.createDataFrame(windows, "window long, sta string, samples array<double>").repartition(3)
    got = {(r.window, r.template, r.lag): r.xc for r in library.library_hits(w, t, 0.85, recall=0.95).collect()}
    assert set(got) <= set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)  # no false hit
    assert len(want) > 60 and len(got) >= 0.95 * len(want)
    assert not library.library_hits(w, t.where("false"), 0.85).collect()


def test_candidates_are_few(spark):
    """What is correlated exactly, of all places: the index leaves most of them out."""
    rng = np.random.default_rng(4)
    templates = a_library(rng, 600, (64,))
    windows = windows_of(rng, templates, 40)
    bits, tables = library.sketch_size(300, 0.9, 0.9)
    index = library.template_words(spark.createDataFrame(templates, "template long, sta string, samples array<double>"), bits, tables, 7)
    full = {64: np.full((tables << bits) // 8 + 1, 255, np.uint8)}
    met = library.window_words(spark.createDataFrame(windows, "window long, sta string, samples array<double>"), full, bits, tables, 7).join(index, ["sta", "size", "tab", "word"]).select("window", "template", "lag").distinct().count()
    assert met < 0.5 * sum(97 * sum(t[1] == w[1] for t in templates) for w in windows)


def test_sketches_grow_with_the_library():
    assert library.sketch_size(10, 0.9, 0.9)[0] == library.LEAST_BITS
    small, large = library.sketch_size(1000, 0.9, 0.99), library.sketch_size(1_000_000, 0.9, 0.99)
    assert small[0] < large[0] == library.MOST_BITS and small[1] < large[1]
    for bits, tables in (small, large):
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.99


def test_proposals(spark):
    hits = spark.createDataFrame([(1, 10, 5, 0.9), (2, 11, 8, 0.8), (1, 10, 6, 0.7), (1, 12, 0, 0.95), (3, 11, 8, 0.99)], "window long, template long, lag int, xc double")
    windows = spark.createDataFrame([(1, "A", 100.0, 1.0), (2, "B", 100.0, 1.0), (3, "A", 0.0, 1.0)], "window long, sta string, stime double, srate double")
    history = spark.createDataFrame([(10, 7, "A", 5.0, 40), (11, 7, "B", 8.0, 40), (12, 8, "A", 0.0, 40)], "template long, evid long, sta string, travel_time double, n int")
    got = {r.evid: r for r in library.proposals(hits, windows, history).collect()}
    gain = lambda xc: -20 * math.log(1 - xc * xc)
    assert got[7].n_sta == 2 and math.isclose(got[7].score, gain(0.9) + gain(0.8)) and math.isclose(got[7].otime, 100.0)
    assert got[8].n_sta == 1 and math.isclose(got[8].score, gain(0.95))
    share = 1 / (1 + math.exp(got[8].score - got[7].score))
    assert math.isclose(got[7].weight, 0.95 * share + 0.025) and math.isclose(got[7].weight + got[8].weight, 1)


def enumerated(pairs):
    """Marginals by all states, each a set of pairs without a common side."""
    out, z = dict.fromkeys(((i, g) for i, g, _ in pairs), 0.0), 0.0
    for k in range(len(pairs) + 1):
        for state in itertools.combinations(pairs, k):
            if len({i for i, _, _ in state}) == len({g for _, g, _ in state}) == k:
                w = math.exp(sum(s for *_, s in state))
                z += w
                for i, g, _ in state:
                    out[i, g] += w
    return {k: x / z for k, x in out.items()}


def test_marginals_of_trees_and_loops(spark):
    rng = random.Random(6)
    pairs, want = [], {}
    for comp in range(12):
        base = comp * 100
        own = [(base, base, rng.gauss(0, 3))]
        for k in range(1, rng.randint(1, 9)):  # a tree: each pair has one new side
            i, g, _ = own[rng.randrange(len(own))]
            own.append((i, base + k, rng.gauss(0, 6)) if k % 2 else (base + k, g, rng.gauss(0, 6)))
        if comp % 3 == 0 and len(own) > 3:  # and loops
            have = {(i, g) for i, g, _ in own}
            own += [(i, g, rng.gauss(0, 2)) for i, g in itertools.product({i for i, *_ in own}, {g for _, g, _ in own}) if (i, g) not in have][:4]
        pairs += own
        want |= enumerated(own)
    pairs += [(5000, 6000 + k, 40.0 * (k == 0)) for k in range(30)]  # a sure pair among many
    want |= {(5000, 6000 + k): math.exp(40.0 * (k == 0)) / (1 + math.exp(40) + 29) for k in range(30)}
    df = spark.createDataFrame(pairs, "id long, gid long, log_odds double").repartition(3)
    got = {(r.id, r.gid): r.p for r in association.marginals(df).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-7, abs_tol=1e-15) for k in want)


def test_messages_on_loops_are_near(spark):
    """Beyond MOST_PAIRS the messages' fixed point stands for the marginals."""
    rng = random.Random(2)
    pairs = [(i, g, rng.gauss(-1, 1)) for i in range(4) for g in range(4)]
    want = enumerated(pairs)
    got = association.message_rounds(spark.createDataFrame(pairs, "id long, gid long, log_odds double")).collect()
    assert max(abs(r.p - want[r.id, r.gid]) for r in got) < 0.05
    assert all(sum(r.p for r in got if r.id == i) <= 1 for i in range(4))


def test_distribution_and_odds(spark):
    a = spark.createDataFrame([(1, "A", 100.0, 1.0, 0.5), (2, "A", 500.0, 1.0, 0.5), (3, "B", 100.0, 0.0, 1.0)], "id long, sta string, atime double, amp double, amp_sd double")
    t = spark.createDataFrame([(9, "A", 103.0, 1.5), (8, "A", 96.0, 0.0), (7, "A", 900.0, 0.0)], "gid long, sta string, ttime double, coda_height double")
    odds = association.association_odds(a, t, 10.0, rate=0.01).collect()
    normal = lambda x, m, s: -((x - m) ** 2) / (2 * s * s) - math.log(s * math.sqrt(2 * math.pi))
    want = {(1, g): -off / 5 - math.log(10) + normal(h, 1.0, 0.5) - math.log(0.01) - normal(h, 0, 1) for g, off, h in ((9, 3.0, 1.5), (8, 4.0, 0.0))}
    assert {(r.id, r.gid) for r in odds} == set(want) and all(math.isclose(r.log_odds, want[r.id, r.gid]) for r in odds)
    n = spark.createDataFrame([(1, 3), (2, 3), (3, 0)], "id long, n long")
    got = {(r.id, r.gid): r.p for r in association.distribution(spark.createDataFrame(odds), n, 6.0).collect()}
    w = {k: math.exp(x) for k, x in want.items()} | {(1, None): 2.0}
    assert all(math.isclose(got[k], (x / sum(w.values()) + 1e-4 / 3) / 1.0001) for k, x in w.items())
    assert got[2, None] == got[3, None] == 1.0 and len(got) == 5
