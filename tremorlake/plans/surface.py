"""Queries in plain SQL with the library's functions, and streams that are read to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import blocks
from tremorlake.functions import sql as functions
from tremorlake.operators.lineage import shared_path
from tremorlake.streaming import detections as streams

from . import views as v
from .registry import query

_HAV = "degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(lat)-radians(slat))/2),2) + cos(radians(lat))*cos(radians(slat))*pow(sin((radians(lon)-radians(slon))/2),2))))))"


@query("sql_geodesics", v.with_views("origin", "site") + f", p AS (SELECT orid, s.sta, o.lon, o.lat, s.lon AS slon, s.lat AS slat, ondate FROM origin o JOIN site s ON o.orid % (SELECT count(*) FROM site) = s.sta) SELECT orid, sta, round({_HAV}, 5) AS deg, round(radians({_HAV}) * 6371, 3) AS km, (slon - lon + 540) % 360 - 180 + CASE WHEN (slon - lon + 540) % 360 = 0 THEN 360 ELSE 0 END AS turn, epoch(make_date(ondate // 1000, 1, 1) + CAST(ondate % 1000 - 1 AS INTEGER)) AS since FROM p")
def sql_geodesics(spark, sf):
    functions.register(spark)
    v.origin(spark, sf).createOrReplaceTempView("_origin")
    v.site(spark, sf).createOrReplaceTempView("_site")
    return spark.sql(
        "SELECT orid, sta, round(dist_deg(o.lon, o.lat, s.lon, s.lat), 5) AS deg, round(dist_km(o.lon, o.lat, s.lon, s.lat), 3) AS km, degdiff(o.lon, s.lon) AS turn, julian_to_epoch(ondate) AS since "
        "FROM _origin o JOIN _site s ON o.orid % (SELECT count(*) FROM _site) = s.sta"
    )


@query("sql_bulletin", "SELECT event_id AS eventid, floor(epoch(ts)) + 0.25 AS time, (event_id % 90)::DOUBLE AS lat, (event_id % 180)::DOUBLE AS lon, round(value / 100, 1) AS mb FROM events")
def sql_bulletin(spark, sf):
    functions.register(spark)
    e = v.table(spark, sf, "events")
    line = F.concat(F.lit("#  "), F.date_format("ts", "yyyy M d H m s"), F.format_string(".25 %d.0 %d.0 10.0 %.1f 0.1 0.2 0.3 %d\nABC 3.2 1.0 P", F.col("event_id") % 90, F.col("event_id") % 180, F.round(F.col("value") / 100, 1), "event_id"))
    # a text for each user and day
    e.select("user_id", F.to_date("ts").alias("day"), line.alias("line")).groupBy("user_id", "day").agg(F.concat_ws("\n", F.collect_list("line")).alias("text")).createOrReplaceTempView("_bulletins")
    return spark.sql("SELECT p.eventid, p.time, p.lat, p.lon, p.mb FROM _bulletins, LATERAL phase_bulletin(text) AS p")


def _arriving(spark, sf, name, rows):
    """The rows in the order of time, a quarter of the whole time after the other, for a stream to read one at a time."""
    path = shared_path(spark, name)
    first, last = v.table(spark, sf, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - first) * 4 / max(1, last - first)))
    for k in range(4):
        rows.where(quarter == k).coalesce(1).write.mode("append").parquet(path)
    return streams.read_detections(spark, path, rows.schema, 1)


@query("stream_uptime", "SELECT user_id AS sta, epoch(date_trunc('hour', ts)) AS hour, count(*) AS n_arrivals FROM events GROUP BY 1, 2")
def stream_uptime(spark, sf):
    rows = v.table(spark, sf, "events").select(F.col("user_id").alias("sta"), F.col("ts").cast("timestamp").alias("ts"))
    got = streams.snapshots(streams.uptime(_arriving(spark, sf, "arriving", rows)), ["sta", "hour"], shared_path(spark, "uptime"))
    return got.select("sta", (F.unix_micros("hour") / 1e6).alias("hour"), "n_arrivals")


@query("stream_interval_join", "SELECT a.event_id AS arid, b.event_id AS evid FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> 'purchase' AND b.event_type = 'purchase' AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL 1800 SECONDS")
def stream_join(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", F.col("user_id").alias("sta"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = _arriving(spark, sf, "found", e.where("event_type <> 'purchase'").select(F.col("event_id").alias("arid"), "sta", "ts"))
    events = _arriving(spark, sf, "events", e.where("event_type = 'purchase'").select(F.col("event_id").alias("evid"), "sta", "ts"))
    return streams.finished(streams.followed(events, found, 1800), shared_path(spark, "joined")).select("arid", "evid")


_PERIOD = "WITH e AS (SELECT epoch(ts) AS t FROM events), p AS (SELECT min(t) AS s, max(t) + 1 AS f FROM e), "


def _period(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return v.table(spark, sf, "events").agg(F.min(t), F.max(t) + 1).first()


@query("stream_fixed_blocks", _PERIOD + "n AS (SELECT s, f, greatest(1, floor((f - s) / 3600)) AS n FROM p), b AS (SELECT CAST(least(floor((t - s) / 3600), n - 1) AS BIGINT) AS block, s, f, n FROM e, n) SELECT block, s + block * 3600 AS stime, CASE WHEN block = n - 1 THEN f ELSE s + (block + 1) * 3600 END AS etime, count(*) AS n FROM b GROUP BY b.block, s, f, b.n")
def stream_fixed_blocks(spark, sf):
    first, last = _period(spark, sf)
    rows = _arriving(spark, sf, "arriving", v.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")))
    counts = streams.in_blocks(rows.withColumn("t", F.unix_micros("ts") / 1e6), blocks.fixed_block("t", first, last, 3600))
    return streams.snapshots(counts, ["block", "stime", "etime"], shared_path(spark, "blocks"))


@query("scan_blocks", _PERIOD + "n AS (SELECT s, f, ceil((f - s) / 7200) AS n, (f - s) / ceil((f - s) / 7200) AS w FROM p), b AS (SELECT k AS block, s + k * w AS stime, CASE WHEN k = n - 1 THEN f ELSE s + (k + 1) * w END AS etime FROM n, (SELECT unnest(generate_series(0, CAST((SELECT n FROM n) AS BIGINT) - 1)) AS k)) SELECT block, round(stime, 3) AS stime, round(etime, 3) AS etime, count(*) AS n FROM b JOIN e ON t >= stime AND t < etime GROUP BY 1, 2, 3")
def scan_blocks(spark, sf):
    first, last = _period(spark, sf)
    rows = v.arrival(spark, sf).select(F.col("time").alias("t"))
    return streams.in_blocks(rows, blocks.equal_block("t", first, last, 7200)).select("block", F.round("stime", 3).alias("stime"), F.round("etime", 3).alias("etime"), "n")
