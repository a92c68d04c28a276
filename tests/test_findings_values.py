"""Queries against values that their SQL has on rows the small tables lack."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from tremorlake.plans import catalogue
from tremorlake.plans.scalars import signed_round

QUERIES = catalogue.queries()
AT = datetime.datetime(2024, 1, 1)


def test_logarithm_of_zero_is_minus_infinity(spark, tmp_path):
    rows = [(1, AT, 1, "view", 0.0), (2, AT, 1, "view", 2.0), (3, AT, 1, "click", 1.0), (4, AT, 1, "click", math.e)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r for r in QUERIES["a26_estimators"](spark, str(tmp_path)).collect()}
    assert got["view"].mu == -math.inf and math.isnan(got["view"].sigma) and (got["click"].mu, got["click"].sigma) == (0.5, 0.5)


def test_rounded_latitude_keeps_its_sign(spark):
    # Spark's own round has no zero that is less than 0
    r = spark.createDataFrame([(-1e-7,), (1e-7,), (-0.1,)], "x double").select(signed_round(F.col("x"), 5).alias("r")).toPandas()["r"].to_numpy()
    assert r.tolist() == [0.0, 0.0, -0.1] and np.signbit(r).tolist() == [True, False, True]


def _embeddings(spark, path, ids):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(int(i), rng.normal(size=64).tolist(), 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_shifts_pair_recordings_of_one_event_only(spark, tmp_path):
    _embeddings(spark, tmp_path, [*range(5), *range(18000, 18005)])
    got = QUERIES["m24_pair_shifts"](spark, str(tmp_path)).toPandas()
    assert len(got) == 20 and (got["a"] // 5 == got["b"] // 5).all()


def test_alignment_of_fewer_recordings(spark, tmp_path):
    _embeddings(spark, tmp_path, range(8))
    d = QUERIES["m24_pair_shifts"](spark, str(tmp_path)).toPandas()
    got = QUERIES["m24_alignment"](spark, str(tmp_path)).toPandas().set_index("node")["x"]
    want = d.groupby("b")["d"].sum().reindex(range(8), fill_value=0) - d.groupby("a")["d"].sum().reindex(range(8), fill_value=0)
    assert len(got) == 8 and np.allclose(got.sort_index(), want / 5.25, atol=1e-6)


def test_last_bits_before_the_date_line_and_zero(spark, tmp_path):
    # orders of a larger copy whose longitude comes out a last bit before 180 or below 0; SQL has -180 and 0
    import duckdb

    rows = [(7253640, 729240, 478514.16), (8137080, 819180, 460325.42), (6251400, 615480, 149000.06), (7570440, 751460, 430342.93), (8790660, 872740, 464545.6), (8017020, 796260, 301658.88), (1, 2192, 372772.98)]
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(*r, AT) for r in rows], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(path)
    got = {r.orid: (repr(r.lon2), repr(r.lat2)) for r in QUERIES["x06_destination"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    assert got == {k: (repr(lon), repr(lat)) for k, lon, lat in con.sql(f"SELECT orid, lon2, lat2 FROM ({catalogue.oracle_sql()['x06_destination']})").fetchall()}
    assert [got[k][0] for k in (7570440, 8790660, 6251400)] == ["-180.0", "-180.0", "0.0"]
