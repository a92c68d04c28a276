"""Travel times, slowness, inversion and location priors as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import geo, tables, travel

from . import views as v
from .registry import query

_PLACES = "p AS (SELECT event_id, value * 0.5 AS d, (event_id % 800)::DOUBLE AS z FROM events)"
_INSIDE = "d <= 180 AND z <= 700"


def _places(spark, sf):
    return v.table(spark, sf, "events").select("event_id", (F.col("value") * 0.5).alias("d"), (F.col("event_id") % 800).cast("double").alias("z"))


def _cells(spark):
    # a table of nodes that is bilinear in itself, so that slopes have to be exact
    nodes = spark.range(19 * 8).select((F.col("id") % 19 * 10.0).alias("d"), (F.floor(F.col("id") / 19) * 100.0).alias("z")).withColumn("tt", 10 + F.col("d") * 8 - F.col("z") * 0.01 + F.col("d") * F.col("z") * 0.0005)
    return tables.grid_cells(nodes, "d", "z", "tt", 10.0, 100.0)


@query("x17_travel_gradients", f"WITH {_PLACES} SELECT event_id, round(CASE WHEN {_INSIDE} THEN 8 + z * 0.0005 END, 8) AS by_distance, round(CASE WHEN {_INSIDE} THEN -0.01 + d * 0.0005 END, 8) AS by_depth FROM p")
def x17(spark, sf):
    got = travel.bilinear_gradient(_places(spark, sf), _cells(spark), "d", "z", 10.0, 100.0, 18, 7)
    return got.select("event_id", F.round("d_x", 8).alias("by_distance"), F.round("d_y", 8).alias("by_depth"))


@query("x18_slowness_incidence", f"WITH {_PLACES}, s AS (SELECT event_id, CASE WHEN {_INSIDE} THEN 8 + z * 0.0005 END AS slow, (event_id * 37 % 360 - 180.0) AS lon, (event_id * 17 % 161 - 80.0) AS lat, {_INSIDE} AS in_range FROM p) SELECT event_id, round(slow, 6) AS slowness, round(degrees(asin(slow / (pi() / 180 * 6371.0) * 5.8)), 6) AS incidence, in_range FROM s")
def x18(spark, sf):
    got = travel.bilinear_gradient(_places(spark, sf), _cells(spark), "d", "z", 10.0, 100.0, 18, 7)
    return got.select("event_id", F.round("d_x", 6).alias("slowness"), F.round(travel.incidence(F.col("d_x"), 5.8), 6).alias("incidence"), F.col("d_x").isNotNull().alias("in_range"))


#: Slowness in seconds a degree over distance in degrees.
_SLOW = [(0.0, 20.0), (30.0, 12.0), (60.0, 8.0), (100.0, 4.0)]


@query(
    "x19_located_detections",
    "WITH a AS (SELECT event_id AS arid, user_id AS sta, (event_id * 7 % 360)::DOUBLE AS azimuth, (event_id % 40)::DOUBLE AS slow FROM events), s AS (SELECT s_suppkey AS sta, (s_suppkey * 37 % 360 - 180.0) AS lon, (s_suppkey * 17 % 181 - 90.0) AS lat FROM supplier), "
    "d AS (SELECT arid, lon, radians(lat) AS y, radians(azimuth) AS w, CASE WHEN slow >= 20 THEN 0 WHEN slow >= 12 THEN (20 - slow) / 8 * 30 WHEN slow >= 8 THEN 30 + (12 - slow) / 4 * 30 WHEN slow >= 4 THEN 60 + (8 - slow) / 4 * 40 ELSE 100 END AS deg FROM a JOIN s USING (sta)), "
    "q AS (SELECT *, asin(greatest(-1.0, least(1.0, sin(y) * cos(radians(deg)) + cos(y) * sin(radians(deg)) * cos(w)))) AS lat2 FROM d), "
    "r AS (SELECT arid, deg, degrees(lat2) AS lat, radians(lon) + atan2(sin(w) * sin(radians(deg)) * cos(y), cos(radians(deg)) - sin(y) * sin(lat2)) AS x FROM q) "
    "SELECT arid, round(deg, 6) AS deg, round(lat, 5) AS lat, round(cos(x), 5) + 0.0 AS east FROM r",
)
def x19(spark, sf):
    both = v.arrival(spark, sf).select("arid", "sta", "azimuth", "slow").join(v.site(spark, sf).select("sta", "lon", "lat"), "sta")
    lon, lat, degrees = travel.located_by_slowness("lon", "lat", "azimuth", "slow", _SLOW)
    # longitude as its cosine, which has no seam at the date line
    return both.select("arid", F.round(degrees, 6).alias("deg"), F.round(lat, 5).alias("lat"), (F.round(F.cos(F.radians(lon)), 5) + 0.0).alias("east"))


@query(
    "x26_location_prior",
    "WITH e AS (SELECT event_id, (event_id * 37 % 360 - 180.0) AS lon, (event_id * 17 % 161 - 80.0) AS lat, (event_id % 800)::DOUBLE AS depth FROM events), "
    "g AS (SELECT *, pmod_lon / 10 AS u, (1 + sin(radians(lat))) / 0.1 AS w FROM (SELECT *, lon + 180 AS pmod_lon FROM e)), "
    "n AS (SELECT *, CAST(floor(u) AS BIGINT) AS i, CAST(least(floor(w), 19) AS BIGINT) AS j FROM g), "
    "p AS (SELECT event_id, depth, (1 + i % 36 % 5 + j) * (1 - (u - i)) * (1 - (w - j)) + (1 + (i + 1) % 36 % 5 + j) * (u - i) * (1 - (w - j)) + (CASE WHEN j = 19 THEN 30 ELSE 2 + i % 36 % 5 + j END) * (1 - (u - i)) * (w - j) + (CASE WHEN j = 19 THEN 30 ELSE 2 + (i + 1) % 36 % 5 + j END) * (u - i) * (w - j) AS p FROM n) "
    "SELECT event_id, round(CASE WHEN depth > 700 THEN -40 ELSE ln(p) - ln(10) - ln(0.1) + ln(0.7 * exp(-depth / 5.0) / 5.0 + 0.3 * CASE WHEN depth > 6.27209 THEN pow((depth - 6.27209) / 126.7144, 0.41801048) * exp(-(depth - 6.27209) / 126.7144) / (gamma(1.41801048) * 126.7144) ELSE 0 END) END, 5) AS lp FROM p",
)
def x26(spark, sf):
    e = F.col("event_id")
    rows = v.table(spark, sf, "events").select("event_id", (e * 37 % 360 - 180.0).cast("double").alias("lon"), (e * 17 % 161 - 80.0).cast("double").alias("lat"), (e % 800).cast("double").alias("depth"))
    nodes = spark.range(36 * 21).select((F.col("id") % 36).alias("i"), F.floor(F.col("id") / 36).alias("j")).withColumn("p", F.when(F.col("j") == 20, 30.0).otherwise(1.0 + F.col("i") % 5 + F.col("j")))
    return travel.location_log_density(rows, nodes, 36, 20).select("event_id", F.round("lp", 5).alias("lp"))


@query("m30_likelihood_grid", "WITH s AS (SELECT (s_suppkey * 37 % 360 - 180.0) AS slon, (s_suppkey * 17 % 181 - 90.0) AS slat FROM supplier), c AS (SELECT unnest(generate_series(0, 71)) AS cell), p AS (SELECT cell, cell % 12 * 30.0 - 165 AS clon, floor(cell / 12) * 30.0 - 75 AS clat FROM c), d AS (SELECT cell, degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(clat)-radians(slat))/2),2) + cos(radians(clat))*cos(radians(slat))*pow(sin((radians(clon)-radians(slon))/2),2)))))) AS d FROM p, s) SELECT CAST(cell AS BIGINT) AS cell, round(sum(-0.5 * pow((d - 60) / 20, 2)), 4) AS lp FROM d GROUP BY 1")
def m30(spark, sf):
    # the cells are a list in each station's row, so that the sums are partial in each task
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(71).cast("long"))).alias("cell")
    s = v.site(spark, sf).select("lon", "lat", cell).withColumns({"clon": F.col("cell") % 12 * 30.0 - 165, "clat": F.floor(F.col("cell") / 12) * 30.0 - 75})
    z = (geo.dist_deg("clon", "clat", "lon", "lat") - 60) / 20
    return s.groupBy("cell").agg(F.round(F.sum(-0.5 * z * z), 4).alias("lp"))
