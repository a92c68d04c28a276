"""Queries over whole tables against brute force."""

import datetime
import os

import numpy as np
import pytest

from tremorlake.operators import models
from tremorlake.plans import catalogue
from tremorlake.plans import views as v

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def degrees(a, b):
    """Great-circle distances of all pairs of frames with lon and lat."""
    x, y = (np.radians(f[["lon", "lat"]].to_numpy(float)) for f in (a, b))
    h = np.sin((x[:, None, 1] - y[None, :, 1]) / 2) ** 2 + np.cos(x[:, None, 1]) * np.cos(y[None, :, 1]) * np.sin((x[:, None, 0] - y[None, :, 0]) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def test_regional_counts_take_all_events(spark):
    site, origin = v.site(spark, SF).toPandas(), v.origin(spark, SF).toPandas()
    d = degrees(site, origin)  # coordinates are whole degrees, so some events lie on the border itself
    got = {r.sta: r.n for r in QUERIES["a16_regional_counts"](spark, SF).collect()}
    n = np.array([got[s] for s in site["sta"]])
    assert len(got) == len(site) and ((d < 6 - 1e-6).sum(axis=1) <= n).all() and (n <= (d < 6 + 1e-6).sum(axis=1)).all()


def test_new_events_are_far_from_all_known_ones(spark):
    origin, gold = v.origin(spark, SF).toPandas(), v.gold(spark, SF).toPandas()
    far = (degrees(origin, gold) * 111.19492664455873 > 250).all(axis=1)
    got = [r.id for r in QUERIES["f14_de_novo"](spark, SF).collect()]
    assert sorted(got) == sorted(origin["orid"][far]) and 0 < len(got) < len(origin)


def test_array_sites_are_multiples_of_ten(spark):
    # j24's condition on the array leaves nothing out: refsta names no other sites
    s = v.site(spark, SF)
    assert s.where("refsta % 10 <> 0").isEmpty()


def test_process_of_many_points_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40, 3000).astype(float), rng.normal(5, 2, 3000)
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "sta int, x double, y double")
    got = models.gaussian_process(rows, ["sta"], [3.0, 90.0], "x", "y", 10.0, 0.5).orderBy("at").toPandas()
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None, :]) / 10.0) ** 2)
    q = np.array([3.0, 90.0])
    weights = np.linalg.solve(kernel(x, x) + 0.25 * np.eye(3000), kernel(x, q))
    assert np.allclose(got["mean"], y.mean() + weights.T @ (y - y.mean()))
    assert np.allclose(got["var"], 1.25 - (weights * kernel(x, q)).sum(axis=0))


def test_all_stations_have_a_process(spark):
    got = QUERIES["m08_gaussian_process"](spark, "/root/testdata/sf0.01").select("sta").distinct().count()
    assert got == v.arrival(spark, "/root/testdata/sf0.01").select("sta").distinct().count() > 20


def test_all_events_are_located_from_all_stations(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(s, float(s)) for s in range(20, 40)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, at, i % 5, "view", 1.0) for i in range(57, 90)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["m22_locations"](spark, str(tmp_path)).toPandas().set_index("evid")
    gold = v.gold(spark, str(tmp_path)).toPandas().set_index("id").loc[got.index]
    assert sorted(got.index) == list(range(57, 90, 3))
    assert np.median(np.diag(degrees(got, gold))) < 0.05


@pytest.mark.parametrize("shuffles", ["1", "7"])
def test_every_row_has_its_place(spark, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        arrivals = v.arrival(spark, SF).toPandas().sort_values(["time", "arid"])["arid"].tolist()
        sites = v.site(spark, SF).toPandas().sort_values(["statype", "ondate", "sta"], ascending=[True, False, True])["sta"].tolist()
        for name, key, want in (("k01_order", "arid", arrivals), ("k02_multi_key", "sta", sites)):
            got = QUERIES[name](spark, SF).toPandas().sort_values("place")
            assert got[key].tolist() == want and got["place"].tolist() == list(range(1, len(want) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
