"""Functions in plain SQL against the column expressions, table functions, and streams that are read to their end."""

import random

from pyspark.sql import functions as F

from tremorlake.functions import geo, names, sql
from tremorlake.streaming import detections


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    rng = random.Random(1)
    rows = [(rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(0.0, 90.0, 5.0, 90.0), (180.0, 0.0, -180.0, 0.0), (1.0, 2.0, 1.0, 2.0)]
    spark.createDataFrame(rows, "lon1 double, lat1 double, lon2 double, lat2 double").createOrReplaceTempView("points")
    p = ("lon1", "lat1", "lon2", "lat2")
    got = spark.sql("SELECT lon1, lat1, dist_deg(lon1, lat1, lon2, lat2), dist_km(lon1, lat1, lon2, lat2), degdiff(lon1, lon2), wrap_lon(lon1 + lon2), azimuth(lon1, lat1, lon2, lat2) FROM points").collect()
    want = spark.table("points").select("lon1", "lat1", geo.dist_deg(*p), geo.dist_km(*p), geo.degdiff("lon1", "lon2"), geo.wrap_lon(F.col("lon1") + F.col("lon2")), geo.azimuth(*p)).collect()
    for a, b in zip(got, want):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b)), (a, b)
    days = spark.createDataFrame([(2024060,), (-1,), (1999365,)], "d int")
    days.createOrReplaceTempView("days")
    assert spark.sql("SELECT julian_to_epoch(d) AS t FROM days ORDER BY d").collect() == days.orderBy("d").select(names.julian_to_epoch("d").alias("t")).collect()


def test_sql_functions_are_inlined(spark):
    sql.register(spark)
    plan = spark.sql("SELECT dist_deg(0D, 0D, id, 0D) AS d FROM range(5) WHERE dist_deg(0D, 0D, id, 0D) > 2")._jdf.queryExecution().executedPlan().toString()
    assert "ASIN" in plan and "Python" not in plan


def test_bulletin_table_function(spark):
    sql.register(spark)
    line = "# 2024 1 2 3 4 5.25 10.0 20.0 30.0 4.5 0.1 0.2 0.3 77"
    texts = [(1, f"{line}\nABC 1 2 P\n  {line.replace('77', '78')} 9\n"), (2, None), (3, "# 2024 13 2 3 4 5 10 20 30 4.5 0 0 0 1\n# too short\n" + line.replace("77", "x"))]
    spark.createDataFrame(texts, "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, p.* FROM texts, LATERAL phase_bulletin(text) AS p ORDER BY eventid").collect()
    assert [tuple(r) for r in got] == [(1, 9, 1704164645.25, 10.0, 20.0, 30.0, 4.5), (1, 77, 1704164645.25, 10.0, 20.0, 30.0, 4.5)]


def test_snapshots_and_joins_of_streams(spark, tmp_path):
    rows = [(k % 3, 720_000 + k * 700) for k in range(40)]
    df = spark.createDataFrame(rows, "sta long, s long").select("sta", F.timestamp_seconds("s").alias("ts"))
    for k in range(4):  # files in the order of time
        df.where(F.floor((F.unix_seconds("ts") - 720_000) / 7000) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: detections.read_detections(spark, f"{tmp_path}/in", df.schema, 1)
    got = detections.snapshots(detections.uptime(stream()), ["sta", "hour"], f"{tmp_path}/a").select("sta", F.unix_seconds("hour"), "n_arrivals").collect()
    want: dict = {}
    for s, t in rows:
        want[s, t // 3600 * 3600] = want.get((s, t // 3600 * 3600), 0) + 1
    assert {tuple(r)[:2]: r[2] for r in got} == want and len(got) == len(want)
    pairs = detections.finished(detections.followed(stream(), stream(), 2100), f"{tmp_path}/b").select("sta", F.unix_seconds("event_ts"), F.unix_seconds("ts")).collect()
    assert sorted(map(tuple, pairs)) == sorted((s, t, u) for s, t in rows for x, u in rows if s == x and 0 <= u - t <= 2100)
