"""Ranks, medians and latest values with a group of most rows, nulls and ties, against plain forms."""

import random
import statistics

import pytest

from tremorlake.operators import joins, ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [(k, "hot" if k % 3 else rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40)), rng.random() * 40])) for k in range(900)] + [(1000, "none", None), (1001, "one", 5.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield out, spark.createDataFrame(out, "id long, g string, x double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_medians(spark, rows):
    out, df = rows
    got = {r.g: r.med for r in ranks.medians(df, ["g"], "x").collect()}
    values = {g: [x for _, k, x in out if k == g and x is not None] for g in {r[1] for r in out}}
    assert got == {g: statistics.median(v) if v else None for g, v in values.items()}
    assert ranks.medians(df, [], "x").first().med == statistics.median(x for *_, x in out if x is not None)
    assert ranks.medians(df.where("false"), [], "x").first().med is None and not ranks.medians(df.where("false"), ["g"], "x").collect()
    plan = ranks.medians(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan  # no map of a group's values


def test_ranks(rows):
    out, df = rows
    got = {r.id: (r["rank"], r["size"]) for r in ranks.ranked(df.dropna(), ["g"], ["x", "id"]).collect()}
    groups: dict = {}
    for k, g, x in out:
        if g is not None and x is not None:
            groups.setdefault(g, []).append((x, k))
    assert got == {k: (i + 1, len(v)) for v in groups.values() for i, (_, k) in enumerate(sorted(v))}


def test_latest_carries_over_partitions(spark, rows):
    out, df = rows
    right = [("hot", 3.0, 1), ("hot", 3.0, 2), ("hot", 30.0, None), ("a", 0.0, 7), ("b", 39.0, 9), (None, 1.0, 5)]
    got = {r.id: r.v for r in joins.asof_join(df.where("x IS NOT NULL"), spark.createDataFrame(right, "g string, t double, v int"), "g", "x", "t", "v").collect()}
    want = {}
    for k, g, x in out:
        if x is not None:
            before = [(t, v) for h, t, v in right if h == g and t <= x and v is not None]
            want[k] = max(before)[1] if before else None
    assert got == want
