"""The exact precision-recall curve against a new matching at every prefix."""

import random

from tremorlake.operators import matching


def greatest(edges):
    """Pairs of a greatest matching, by trying all."""
    best = 0

    def go(k, golds, guesses, n):
        nonlocal best
        best = max(best, n)
        for j in range(k, len(edges)):
            if n + len(edges) - j <= best:
                break
            a, b = edges[j]
            if a not in golds and b not in guesses:
                go(j + 1, golds | {a}, guesses | {b}, n + 1)

    go(0, frozenset(), frozenset(), 0)
    return best


def test_every_prefix_is_matched_anew(spark):
    rng = random.Random(9)
    gold = [(k, 1000.0 * (k // 4) + rng.uniform(0, 60), 0.0, 0.0) for k in range(24)]
    guess = [(k, 1000.0 * (k // 5) + rng.uniform(0, 60), 0.0, rng.choice([0.0, 5.0]), rng.randint(0, 8) / 8) for k in range(30)]
    g = spark.createDataFrame(gold, "id long, t double, lon double, lat double").repartition(2)
    q = spark.createDataFrame(guess, "id long, t double, lon double, lat double, score double").repartition(2)
    got = {r.score: (r.n_true, r.n_all, r.precision, r.recall) for r in matching.exact_curve(g, q, 25.0, 1.0).collect()}
    edges = [(a[0], b[0], b[4]) for a in gold for b in guess if abs(a[1] - b[1]) <= 25 and b[3] == 0]
    assert len(got) == len({b[4] for b in guess})
    contested = 0
    for s, row in got.items():
        # groups of golds and guesses a thousand seconds apart are independent
        n = sum(greatest([(a, b) for a, b, score in edges if score >= s and a // 4 == c]) for c in range(6))
        n_all = sum(b[4] >= s for b in guess)
        assert row == (n, n_all, n / n_all, n / 24)
        contested += n < min(sum(score >= s for *_, score in edges), 24)
    assert contested


def test_paths_free_a_gold():
    # the third guess only fits if both others move on
    assert matching._enter([["a", "b"], ["b", "c"], ["a"], ["a", "b", "c"]], [0, 1, 2, 3]) == [True, True, True, False]
    assert matching._enter([["a"], [], ["a"]], [2, 1, 0]) == [False, False, True]


def test_no_guesses(spark):
    g = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, t double, lon double, lat double")
    q = spark.createDataFrame([], "id long, t double, lon double, lat double, score double")
    assert not matching.exact_curve(g, q).collect()


def test_rounds_of_components_leave_one_table(spark, monkeypatch, tmp_path):
    from tremorlake.operators import graphs, lineage

    monkeypatch.setattr(lineage, "shared_folder", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(i, i) for i in range(60)] + [(i, i + 1) for i in range(60)], "id long, gid long")
    few = graphs.components.__defaults__
    monkeypatch.setattr(graphs.components, "__defaults__", (*few[:-1], 0))
    assert {r.comp for r in matching.edge_components(edges).collect()} == {0}
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("stars-")]) == 1  # of all rounds the last
