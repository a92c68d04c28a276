"""Distance joins on the sphere against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.operators import sphere


def points(seed, n):
    """Points anywhere, at both poles, at the date line, and in a dense cluster."""
    rng = random.Random(seed)
    rows = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]
    rows += [(x, y) for x in (-180.0, 180.0, 179.999, 0.0) for y in (90.0, -90.0, 89.9, -89.5, 0.0, 84.3)]
    rows += [(rng.gauss(179.9, 0.3), rng.gauss(10, 0.3)) for _ in range(n // 4)]
    return [(k, x, y, k % 3, rng.uniform(0, 1000.0)) for k, (x, y) in enumerate(rows)]


def km(a, b):
    x, y = (math.sin(math.radians(p - q) / 2) for p, q in ((a[2], b[2]), (a[1], b[1])))
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(x * x + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * y * y))))


@pytest.mark.parametrize("degrees", [0.7, 6.0, 25.0, 91.0, 180.0])
def test_pairs_equal_all_pairs(spark, degrees):
    a, b = points(1, 120), points(2, 120)
    left = spark.createDataFrame(a, "id long, lon double, lat double, k long, t double").repartition(3)
    right = spark.createDataFrame(b, "o_id long, o_lon double, o_lat double, k long, o_t double").repartition(3)
    got = sphere.near_join(left, right, degrees, keys=["k"]).select("id", "o_id").collect()
    want = {(p[0], q[0]) for p in a for q in b if p[3] == q[3] and km(p, q) <= degrees}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    anti = sphere.near_join(left, right.drop("k"), degrees, F.col("o_id") % 2 == 0, "left_anti").select("id").collect()
    assert {r.id for r in anti} == {p[0] for p in a if not any(q[0] % 2 == 0 and km(p, q) <= degrees for q in b)}
    timed = sphere.near_join(left, right.drop("k"), degrees, times=("t", "o_t"), seconds=70.0).select("id", "o_id").collect()
    want = {(p[0], q[0]) for p in a for q in b if abs(p[4] - q[4]) <= 70 and km(p, q) <= degrees}
    assert len(timed) == len(want) and {tuple(r) for r in timed} == want


def test_candidates_are_a_few_times_the_result(spark):
    """What meets in a cell, before any distance is computed."""
    rng = random.Random(4)
    rows = [(k, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(4000)]
    left = spark.createDataFrame(rows, "id long, lon double, lat double")
    right = left.toDF("o_id", "o_lon", "o_lat")
    near = sphere.near_join(left, right, 4.0).count()
    met = sphere.near_join(left, right, 4.0, within=F.lit(True)).count()
    assert near < met < 5 * near
    assert right.select(F.explode(sphere.cells_near(F.col("o_lon"), F.col("o_lat"), 4.0))).count() < 12 * len(rows)


def test_join_is_an_equi_join(spark):
    left = spark.range(10).select("id", F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat"))
    plan = sphere.near_join(left, left.toDF("o_id", "o_lon", "o_lat"), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nulls_and_bad_distances(spark):
    left = spark.createDataFrame([(1, None, 3.0), (2, 5.0, 5.0)], "id long, lon double, lat double")
    assert [tuple(r) for r in sphere.near_join(left, left.toDF("o_id", "o_lon", "o_lat"), 1.0).select("id", "o_id").collect()] == [(2, 2)]
    with pytest.raises(ValueError):
        sphere.near_join(left, left, 0.0)
    assert geo.EARTH_RADIUS_KM == 6371.0
