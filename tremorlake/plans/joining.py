"""Joins over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import geo, names
from tremorlake.operators import joins as jn
from tremorlake.operators.sphere import near_join, nearest_join

from . import views as v
from .registry import query

_HAV = "degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(a.lat)-radians(b.lat))/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(a.lon)-radians(b.lon))/2),2))))))"


@query("j01_detected_events", v.with_views("arrival", "assoc", "origin") + "SELECT DISTINCT orid, sta, mb FROM arrival JOIN assoc USING (arid) JOIN origin USING (orid) WHERE sta = 7 AND phase IN ('A', 'N') AND mb BETWEEN 3 AND 6 AND snr > 10")
def j01(spark, sf):
    a = v.arrival(spark, sf).where("sta = 7 AND snr > 10").select("arid", "sta")
    return a.join(v.assoc(spark, sf).where("phase IN ('A', 'N')").select("arid", "orid"), "arid").join(v.origin(spark, sf).where("mb BETWEEN 3 AND 6").select("orid", "mb"), "orid").select("orid", "sta", "mb").distinct()


@query("j02_detections", v.with_views("arrival", "site", "phase") + "SELECT arid, id - 1 AS phaseid, statype = 'ar' AS is_array, lon FROM arrival JOIN site USING (sta) JOIN phase ON iphase = phase WHERE delaz > 0 AND delslo > 0 AND snr > 0")
def j02(spark, sf):
    from tremorlake.operators.catalogue import valid_detection

    a = v.arrival(spark, sf).where(valid_detection())
    return a.join(v.site(spark, sf), "sta").join(v.phase(spark).withColumnRenamed("phase", "iphase"), "iphase").select("arid", (F.col("id") - 1).alias("phaseid"), (F.col("statype") == "ar").alias("is_array"), "lon")


@query("j03_five_way", v.with_views("origin", "assoc", "arrival", "site", "phase") + "SELECT orid, arid, p.id AS phaseid, site.lon FROM origin JOIN assoc s USING (orid) JOIN arrival USING (arid) JOIN site USING (sta) JOIN phase p ON p.phase = arrival.iphase WHERE snr >= 20 AND mb > 5")
def j03(spark, sf):
    o = v.origin(spark, sf).where("mb > 5").select("orid")
    s = v.assoc(spark, sf).select("orid", "arid")
    a = v.arrival(spark, sf).where("snr >= 20").select("arid", "sta", F.col("iphase").alias("phase"))
    return o.join(s, "orid").join(a, "arid").join(v.site(spark, sf).select("sta", "lon"), "sta").join(v.phase(spark).select("phase", F.col("id").alias("phaseid")), "phase").select("orid", "arid", "phaseid", "lon")


@query("j04_station_detections", v.with_views("arrival", "phase") + "SELECT arid, time, id FROM arrival JOIN phase ON iphase = phase WHERE sta = 11")
def j04(spark, sf):
    return v.arrival(spark, sf).where("sta = 11").join(v.phase(spark).withColumnRenamed("phase", "iphase"), "iphase").select("arid", "time", "id")


@query("j05_other_events", v.with_views("arrival", "assoc") + "SELECT DISTINCT a.arid FROM arrival a JOIN assoc s USING (arid) WHERE s.orid <> 17 AND a.sta IN (7, 0) AND a.time BETWEEN 1704067200 AND 1704667200")
def j05(spark, sf):
    a = v.arrival(spark, sf).where("sta IN (7, 0) AND time BETWEEN 1704067200 AND 1704667200")
    return a.join(v.assoc(spark, sf).where("orid <> 17"), "arid", "left_semi").select("arid")


@query("j06_nested_lists", v.with_views("origin", "assoc", "arrival") + ", d AS (SELECT DISTINCT orid, arid FROM assoc JOIN arrival USING (arid) WHERE timedef = 'd') SELECT orid, count(arid) AS n, string_agg(CAST(arid AS VARCHAR), ',' ORDER BY arid) AS arids FROM origin LEFT JOIN d USING (orid) GROUP BY orid")
def j06(spark, sf):
    d = v.assoc(spark, sf).where("timedef = 'd'").join(v.arrival(spark, sf).select("arid"), "arid").select("orid", "arid")
    nested = d.groupBy("orid").agg(F.array_sort(F.collect_set("arid")).alias("list"))  # an event's own detections
    out = v.origin(spark, sf).select("orid").join(nested, "orid", "left")
    return out.select("orid", F.coalesce(F.size("list"), F.lit(0)).cast("bigint").alias("n"), F.array_join("list", ",").alias("arids"))


@query("j07_join_using", v.with_views("origin", "assoc") + "SELECT orid, count(*) AS n, max(mb) AS mb FROM origin JOIN assoc USING (orid) GROUP BY orid")
def j07(spark, sf):
    n = v.assoc(spark, sf).groupBy("orid").agg(F.count("*").alias("n"))  # before the join: fewer rows to shuffle
    return n.join(v.origin(spark, sf).select("orid", "mb"), "orid").select("orid", "n", "mb")


@query("j08_semi_join", v.with_views("site", "arrival") + "SELECT sta FROM site WHERE EXISTS (SELECT 1 FROM arrival a WHERE a.sta = site.sta AND a.time BETWEEN 1704067200 AND 1704153600) AND ondate <= 2024005 AND (offdate = -1 OR offdate >= 2024005)")
def j08(spark, sf):
    live = v.site(spark, sf).where("ondate <= 2024005 AND (offdate = -1 OR offdate >= 2024005)")
    return live.join(v.arrival(spark, sf).where("time BETWEEN 1704067200 AND 1704153600"), "sta", "left_semi").select("sta")


@query("j09_anti_join", v.with_views("assoc", "arrival") + "SELECT orid, count(*) AS n FROM assoc WHERE timedef = 'd' AND arid NOT IN (SELECT arid FROM arrival WHERE delaz > 0 AND delslo > 0 AND snr > 0) GROUP BY orid")
def j09(spark, sf):
    from tremorlake.operators.catalogue import valid_detection

    return v.assoc(spark, sf).where("timedef = 'd'").join(v.arrival(spark, sf).where(valid_detection()).select("arid"), "arid", "left_anti").groupBy("orid").agg(F.count("*").alias("n"))


@query("j10_only_these_phases", v.with_views("origin", "assoc") + "SELECT orid FROM origin o WHERE (SELECT count(*) FROM assoc s WHERE s.orid = o.orid AND s.phase NOT IN ('A', 'N')) = 0")
def j10(spark, sf):
    return v.origin(spark, sf).select("orid").join(v.assoc(spark, sf).where("phase NOT IN ('A', 'N')"), "orid", "left_anti")


@query("j11_fit_phases", "SELECT DISTINCT o_orderkey, o_orderpriority, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40")
def j11(spark, sf):
    li = v.table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").distinct()
    return v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey")


@query("j12_fit_noise_model", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j12(spark, sf):
    return v.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_mktsegment")


def _sides(spark, sf):
    a = v.gold(spark, sf).select("id", "t", "lon", "lat")
    b = v.guess(spark, sf).select(F.col("id").alias("gid"), F.col("t").alias("gt"), F.col("lon").alias("glon"), F.col("lat").alias("glat"), "score")
    return a, b


def match_edges(spark, sf, seconds=50.0, degrees=1.0):
    a, b = _sides(spark, sf)
    d = geo.dist_deg("lon", "lat", "glon", "glat")
    return jn.band_join(a, b, "t", "gt", seconds, d <= degrees).withColumn("d", d)


@query("j13_band_join", v.with_views("gold", "guess") + f"SELECT a.id, b.id AS gid, round({_HAV}, 6) AS d FROM gold a JOIN guess b ON a.t BETWEEN b.t - 50 AND b.t + 50 WHERE {_HAV} <= 1.0")
def j13(spark, sf):
    return match_edges(spark, sf).select("id", "gid", F.round("d", 6).alias("d"))


@query("j14_box_join", v.with_views("gold", "guess") + "SELECT count(DISTINCT a.id) AS n FROM gold a JOIN guess b ON abs(a.t - b.t) <= 20 AND abs(a.lon - b.lon) <= 0.5 AND abs(a.lat - b.lat) <= 0.5")
def j14(spark, sf):
    a, b = _sides(spark, sf)
    near = (F.abs(F.col("lon") - F.col("glon")) <= 0.5) & (F.abs(F.col("lat") - F.col("glat")) <= 0.5)
    return jn.band_join(a, b, "t", "gt", 20.0, near, "left_semi").agg(F.count_distinct("id").alias("n"))


@query("j15_pairs", v.with_views("gold") + f"SELECT a.id AS a, b.id AS b FROM gold a JOIN gold b ON a.id < b.id AND b.t - a.t BETWEEN -600 AND 600 WHERE {_HAV} <= 20")
def j15(spark, sf):
    g = v.gold(spark, sf).select("id", "t", "lon", "lat")
    other = g.select(F.col("id").alias("b"), F.col("t").alias("bt"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    return near_join(g, other, 20.0, F.col("id") < F.col("b"), right_at=("blon", "blat"), times=("t", "bt"), seconds=600.0).select(F.col("id").alias("a"), "b")


@query("j16_neighbour_fits", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 300")
def j16(spark, sf):
    a = v.arrival(spark, sf).select("sta", F.col("arid").alias("a"), "time")
    b = v.arrival(spark, sf).select("sta", F.col("arid").alias("b"), F.col("time").alias("btime"))
    return jn.band_join(a, b, "time", "btime", 300.0, F.col("a") != F.col("b"), keys=["sta"]).select("a", "b")


@query("j17_near_in_time_and_space", v.with_views("gold", "guess") + f"SELECT a.id, round(min({_HAV}), 5) AS d FROM gold a JOIN guess b ON abs(a.t - b.t) <= 40 WHERE {_HAV} * 111.19 <= 250 GROUP BY a.id")
def j17(spark, sf):
    a, b = _sides(spark, sf)
    d = geo.dist_deg("lon", "lat", "glon", "glat")
    return near_join(a, b, 250 / 111.19, right_at=("glon", "glat"), within=d * 111.19 <= 250, times=("t", "gt"), seconds=40.0).groupBy("id").agg(F.round(F.min(d), 5).alias("d"))


@query("j18_nearest", v.with_views("gold", "guess") + f", c AS (SELECT a.id, b.id AS gid, {_HAV} + abs(a.t - b.t) / 10 AS cost FROM gold a JOIN guess b ON abs(a.t - b.t) <= 600), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, gid) AS k FROM c) SELECT g.id, r.gid, round(r.cost, 5) AS cost FROM gold g LEFT JOIN r ON g.id = r.id AND k = 1")
def j18(spark, sf):
    a, b = _sides(spark, sf)
    return nearest_join(a, b, "id", "gid", ("t", "gt"), 600.0, 10.0, right_at=("glon", "glat")).select("id", "gid", F.round("cost", 5).alias("cost"))


@query("j19_tolerance_join", v.with_views("gold", "guess") + "SELECT a.id, min(b.id) AS gid FROM gold a JOIN guess b ON abs(a.t - b.t) <= 5 AND abs(a.lon - b.lon) <= 0.3 AND abs(a.lat - b.lat) <= 0.1 GROUP BY a.id")
def j19(spark, sf):
    a, b = _sides(spark, sf)
    near = (F.abs(F.col("lon") - F.col("glon")) <= 0.3) & (F.abs(F.col("lat") - F.col("glat")) <= 0.1)
    return jn.band_join(a, b, "t", "gt", 5.0, near).groupBy("id").agg(F.min("gid").alias("gid"))


@query("j20_interval_overlap", v.with_views("arrival") + ", r AS (SELECT sta, arid AS rid, time AS st, time + 300 AS et FROM arrival), w AS (SELECT sta, arid AS wid, time AS ws, time + 1800 AS we FROM arrival) SELECT rid, count(*) AS n FROM r JOIN w USING (sta) WHERE ws <= et AND st <= we AND ws >= st - 28800 GROUP BY rid")
def j20(spark, sf):
    a = v.arrival(spark, sf)
    r = a.select("sta", F.col("arid").alias("rid"), F.col("time").alias("st"), (F.col("time") + 300).alias("et"))
    w = a.select("sta", F.col("arid").alias("wid"), F.col("time").alias("ws"), (F.col("time") + 1800).alias("we"))
    return jn.overlap_join(r, w, ("st", "et"), ("ws", "we"), 3600.0, F.col("ws") >= F.col("st") - 28800, ["sta"]).groupBy("rid").agg(F.count("*").alias("n"))


@query("j21_asof", v.with_views("arrival") + "SELECT a.arid, max(b.time) IS NOT NULL AS has, round(max(b.time), 3) AS noise_time FROM arrival a LEFT JOIN arrival b ON a.sta = b.sta AND b.iphase = 'error' AND b.time <= a.time GROUP BY a.arid")
def j21(spark, sf):
    a = v.arrival(spark, sf)
    noise = a.where("iphase = 'error'").select("sta", F.col("time").alias("nt"), F.col("time").alias("noise_time"))
    out = jn.asof_join(a.select("sta", "arid", "time"), noise, "sta", "time", "nt", "noise_time")
    return out.select("arid", F.col("noise_time").isNotNull().alias("has"), F.round("noise_time", 3).alias("noise_time"))


@query("j22_safe_blocks", v.with_views("arrival") + ", b AS (SELECT sta, arid, time - 130 AS s, time - 10 AS e FROM arrival) SELECT arid FROM b WHERE NOT EXISTS (SELECT 1 FROM arrival a WHERE a.sta = b.sta AND ((a.time > b.s AND a.time < b.e) OR (b.s - a.time >= 0 AND b.s - a.time < 400)))")
def j22(spark, sf):
    a = v.arrival(spark, sf)
    blocks = a.select("sta", "arid", (F.col("time") - 130).alias("s"), (F.col("time") - 10).alias("e"))
    bad = ((F.col("at") > F.col("s")) & (F.col("at") < F.col("e"))) | ((F.col("s") - F.col("at") >= 0) & (F.col("s") - F.col("at") < 400))
    return jn.band_join(blocks, a.select("sta", F.col("time").alias("at")), "s", "at", 400.0, bad, "left_anti", ["sta"]).select("arid")


@query("j23_validity", v.with_views("arrival", "site") + "SELECT arid FROM arrival JOIN site USING (sta) WHERE time >= epoch(make_date(ondate // 1000, 1, 1) + INTERVAL (ondate % 1000 - 1) DAY) AND (offdate = -1 OR time <= epoch(make_date(2024, 1, 20)))")
def j23(spark, sf):
    s = v.site(spark, sf).select("sta", names.julian_to_epoch("ondate").alias("on"), names.julian_to_epoch("offdate").alias("off"))
    return v.arrival(spark, sf).join(s, "sta").where("time >= on AND (off IS NULL OR time <= off)").select("arid")


@query("j24_array_elements", v.with_views("site") + "SELECT a.sta AS arr, b.sta AS element FROM site a JOIN site b ON b.refsta = a.sta")
def j24(spark, sf):
    s = v.site(spark, sf)
    return s.select(F.col("sta").alias("arr")).join(s.select(F.col("refsta").alias("arr"), F.col("sta").alias("element")), "arr")


@query("j25_work_list", v.with_views("site") + "SELECT n_nationkey AS evid, sta FROM nation CROSS JOIN site WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = sta AND s_nationkey >= n_nationkey)")
def j25(spark, sf):
    # only pairs with data are made: no product of all events and stations
    s = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sta"), F.explode(F.sequence(F.lit(0), F.col("s_nationkey"))).alias("evid"))
    return s.join(v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("evid")), "evid", "left_semi").select("evid", "sta")


@query("j26_bin_lookup", v.with_views("arrival") + ", b AS (SELECT * FROM (VALUES (0, 0.0, 15.0), (1, 10.0, 25.0), (2, 25.0, 35.0)) AS t(bin, lo, hi)) SELECT arid, min(bin) AS bin FROM arrival LEFT JOIN b ON slow >= lo AND slow < hi GROUP BY arid")
def j26(spark, sf):
    bins = spark.createDataFrame([(0, 0.0, 15.0), (1, 10.0, 25.0), (2, 25.0, 35.0)], "bin int, low double, high double")
    return jn.bin_lookup(v.arrival(spark, sf), bins, "slow", "arid").select("arid", "bin")


@query("j27_fallback", v.with_views("gold", "guess") + "SELECT e.event_id AS id, coalesce(a.t, b.t) AS t FROM events e LEFT JOIN gold a ON a.id = e.event_id AND e.event_id % 2 = 0 LEFT JOIN gold b ON b.id = e.event_id")
def j27(spark, sf):
    g = v.gold(spark, sf)
    leb, isc = g.where("id % 2 = 0").select("id", F.col("t").alias("t1")), g.select("id", F.col("t").alias("t2"))
    ids = v.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return ids.join(leb, "id", "left").join(isc, "id", "left").select("id", F.coalesce("t1", "t2").alias("t"))


@query("f14_de_novo", v.with_views("gold", "origin") + ", a AS (SELECT orid AS id, lon, lat FROM origin), b AS (SELECT id, lon, lat FROM gold) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE " + _HAV + " * 111.19492664455873 <= 250)")
def f14(spark, sf):
    a = v.origin(spark, sf).select(F.col("orid").alias("id"), "lon", "lat")
    b = v.gold(spark, sf).select(F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    return near_join(a, b, 250 / 111.0, how="left_anti", right_at=("blon", "blat"), within=geo.dist_km("lon", "lat", "blon", "blat") <= 250).select("id")


@query("u05_priority_union", v.with_views("gold", "guess") + "SELECT id, t FROM gold UNION ALL SELECT id, t FROM guess g WHERE NOT EXISTS (SELECT 1 FROM gold a JOIN guess b ON abs(a.t - b.t) <= 50 WHERE b.id = g.id AND " + _HAV + " <= 1.0)")
def u05(spark, sf):
    from tremorlake.operators.catalogue import priority_union

    a, b = _sides(spark, sf)
    return priority_union(a.select("id", "t"), b.select(F.col("gid").alias("id"), F.col("gt").alias("t")), match_edges(spark, sf).select(F.col("gid").alias("id")).distinct(), "id")
