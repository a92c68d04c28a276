"""Filters, aggregates, set operations and top-k over the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.operators import catalogue as ops
from tremorlake.operators import sequences
from tremorlake.operators.ranks import medians

from . import views as v
from .registry import query

START = 1704067200.0  # of the detections' tables


@query("a01_uptime", f"""SELECT user_id AS site, CAST(trunc((epoch(ts) - {START}) / 3600) AS BIGINT) AS hour, count(*) AS n_arrivals
 FROM events WHERE epoch(ts) BETWEEN {START} AND {START + 7 * 86400 + 2000} GROUP BY 1, 2""")
def a01(spark, sf):
    return ops.uptime(v.arrival(spark, sf), START, START + 7 * 86400).select(F.col("sta").alias("site"), "hour", "n_arrivals")


@query("a01_uptime_matrix", f"""WITH h AS (SELECT unnest(generate_series(0, 25)) AS hour), s AS (SELECT DISTINCT user_id AS sta FROM events),
 c AS (SELECT DISTINCT user_id AS sta, CAST(trunc((epoch(ts) - {START}) / 3600) AS BIGINT) AS hour FROM events WHERE epoch(ts) BETWEEN {START} AND {START + 86400 + 2000})
 SELECT s.sta, CAST(h.hour AS BIGINT) AS hour, c.sta IS NOT NULL AS up FROM s CROSS JOIN h LEFT JOIN c ON c.sta = s.sta AND c.hour = h.hour WHERE h.hour < 25""")
def a01m(spark, sf):
    a = v.arrival(spark, sf)
    return ops.uptime_matrix(a, a.select("sta").distinct(), START, START + 86400)


@query("a02_conditional_counts", v.with_views("assoc") + "SELECT orid, count(*) AS n, count(*) FILTER (phase = 'A') AS n_a, count(*) FILTER (phase = 'R') AS n_r, count(*) FILTER (timedef = 'd') AS n_def FROM assoc GROUP BY orid")
def a02(spark, sf):
    return v.assoc(spark, sf).groupBy("orid").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == "A").alias("n_a"), F.count_if(F.col("phase") == "R").alias("n_r"), F.count_if(F.col("timedef") == "d").alias("n_def"))


@query("a03_having_ranked", "WITH c AS (SELECT user_id AS sta, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60) SELECT sta, n, CAST(row_number() OVER (ORDER BY n DESC, sta) AS BIGINT) AS id FROM c")
def a03(spark, sf):
    n = v.arrival(spark, sf).groupBy("sta").agg(F.count("*").alias("n")).where("n > 60")
    return sequences.ordinal(n.withColumn("down", -F.col("n")), [], ["down", "sta"], "id").select("sta", "n", (F.col("id") + 1).alias("id"))


@query("a04_top_channel", "SELECT event_type AS chan, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, chan LIMIT 1")
def a04(spark, sf):
    return v.arrival(spark, sf).groupBy(F.col("iphase").alias("chan")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chan").limit(1)


@query("a05_mode_channel", "WITH c AS (SELECT user_id AS sta, event_type AS chan, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sta ORDER BY n DESC, chan) AS k FROM c) SELECT sta, chan FROM r WHERE k = 1")
def a05(spark, sf):
    n = v.arrival(spark, sf).groupBy("sta", F.col("iphase").alias("chan")).agg(F.count("*").alias("n"))
    return n.groupBy("sta").agg(F.min_by("chan", F.struct(-F.col("n"), "chan")).alias("chan"))


@query("a06_run_means", "SELECT o_orderpriority AS run, round(avg(o_totalprice), 4) AS mean_cost, round(avg(o_custkey), 4) AS mean_elapsed FROM orders GROUP BY 1")
def a06(spark, sf):
    return v.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_cost"), F.round(F.avg("o_custkey"), 4).alias("mean_elapsed"))


@query("a07_next_run_id", "SELECT coalesce(max(o_orderkey), 0) + 1 AS runid FROM orders")
def a07(spark, sf):
    return ops.next_run_id(v.table(spark, sf, "orders"), "o_orderkey")


@query("a08_error_moments", v.with_views("gold", "guess") + "SELECT round(avg(a.t - b.t), 6) AS mean_dt, round(stddev_pop(a.t - b.t), 6) AS std_dt, round(stddev_pop(a.lon - b.lon), 6) AS std_lon FROM gold a JOIN guess b USING (id)")
def a08(spark, sf):
    both = v.gold(spark, sf).alias("a").join(v.guess(spark, sf).alias("b"), "id")
    dt = F.col("a.t") - F.col("b.t")
    return both.agg(F.round(F.avg(dt), 6).alias("mean_dt"), F.round(F.stddev_pop(dt), 6).alias("std_dt"), F.round(F.stddev_pop(F.col("a.lon") - F.col("b.lon")), 6).alias("std_lon"))


@query("a09_neighbour_median", v.with_views("arrival") + "SELECT sta, iphase, round(median(amp), 6) AS med, round(stddev_pop(amp), 6) AS std, count(*) AS n FROM arrival GROUP BY 1, 2 HAVING count(*) >= 2")
def a09(spark, sf):
    return ops.robust_stats(v.arrival(spark, sf), ["sta", "iphase"], "amp").select("sta", "iphase", F.round("med", 6).alias("med"), F.round("std", 6).alias("std"), "n")


@query("a10_robust_outliers", v.with_views("arrival") + ", s AS (SELECT sta, iphase, median(amp) AS med, stddev_pop(amp) AS std, count(*) AS n FROM arrival GROUP BY 1, 2) SELECT arid, round(abs(amp - med) / nullif(std, 0), 6) AS z FROM arrival JOIN s USING (sta, iphase) WHERE n > 5 AND abs(amp - med) / nullif(std, 0) > 2.5")
def a10(spark, sf):
    return ops.robust_outliers(v.arrival(spark, sf), ["sta", "iphase"], "amp", 2.5, 5).select("arid", F.round("z", 6).alias("z"))


@query("a11_move_stats", "SELECT l_returnflag AS move, count(*) AS attempts, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS med, round(stddev_pop(l_quantity), 6) AS std, max(l_quantity) AS most, min(l_quantity) AS least, round(sum(l_quantity), 3) AS total FROM lineitem GROUP BY 1")
def a11(spark, sf):
    q = "l_quantity"
    moves = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("move"), q)
    med = medians(moves, ["move"], q).select("move", F.round("med", 6).alias("med"))
    return med.join(moves.groupBy("move").agg(F.count("*").alias("attempts"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("std"), F.max(q).alias("most"), F.min(q).alias("least"), F.round(F.sum(q), 3).alias("total")), "move")


@query("a13_event_rate", v.with_views("origin") + "SELECT count(*) / 86400.0 AS rate FROM origin WHERE lon BETWEEN -100 AND 60 AND lat BETWEEN -45 AND 45 AND mb >= 3.5")
def a13(spark, sf):
    return ops.event_rate(v.origin(spark, sf), -100, 60, -45, 45, seconds=86400.0, min_mb=3.5)


@query("a14_bucket_report", v.with_views("gold", "guess") + ", g AS (SELECT DISTINCT a.id, a.mb, b.id IS NOT NULL AS hit FROM gold a LEFT JOIN guess b ON a.id = b.id) SELECT CASE WHEN mb <= 3.1 THEN 0 WHEN mb <= 3.25 THEN 1 WHEN mb <= 3.5 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS recall FROM g GROUP BY 1")
def a14(spark, sf):
    hit = v.gold(spark, sf).join(v.guess(spark, sf).select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return ops.bucket_recall(hit, "mb", [3.1, 3.25, 3.5], F.col("hit").isNotNull())


def _covered(k):
    """The k-th best station as a view c<k>: events that four chosen ones have seen don't count."""
    chosen = " UNION ALL ".join(f"SELECT sta FROM c{i}" for i in range(k)) or "SELECT NULL AS sta LIMIT 0"
    return f"c{k} AS (SELECT {k} AS rank, sta, count(*) AS gain FROM seen WHERE sta NOT IN ({chosen}) AND evid NOT IN (SELECT evid FROM seen WHERE sta IN ({chosen}) GROUP BY evid HAVING count(*) >= 4) GROUP BY sta ORDER BY gain DESC, sta LIMIT 1)"


@query("a15_greedy_coverage", "WITH seen AS (SELECT DISTINCT l_suppkey AS sta, l_orderkey AS evid FROM lineitem), " + ", ".join(map(_covered, range(5))) + " " + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(5)))
def a15(spark, sf):
    seen = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sta"), F.col("l_orderkey").alias("evid")).distinct()
    return ops.greedy_coverage(seen, 5, times=4)


@query("a16_regional_counts", v.with_views("origin", "site") + ", s AS (SELECT sta, lon AS slon, lat AS slat FROM site) SELECT sta, count(*) FILTER (degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat))*sin(radians(slat)) + cos(radians(lat))*cos(radians(slat))*cos(radians(lon)-radians(slon)))))) <= 6) AS n FROM s, origin GROUP BY sta")
def a16(spark, sf):
    sites = v.site(spark, sf).select("sta", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    return ops.regional_counts(sites, v.origin(spark, sf), 6.0)


@query("a17_distinct", "SELECT DISTINCT user_id AS sta, event_type AS iphase FROM events")
def a17(spark, sf):
    return v.arrival(spark, sf).select("sta", "iphase").distinct()


@query("a18_softmax", "WITH m AS (SELECT event_id, user_id, value / 50 AS x, max(value / 50) OVER (PARTITION BY user_id) AS mx FROM events) SELECT event_id, round(exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY user_id), 8) AS p FROM m")
def a18(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "user_id", (F.col("value") / 50).alias("x"))
    return ops.normalise_logs(e, ["user_id"], "x").select("event_id", F.round("p", 8).alias("p"))


@query("a19_spherical_centroid", v.with_views("origin") + ", c AS (SELECT round(depth) % 10 AS eid, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM origin GROUP BY 1) SELECT eid, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(atan2(z, sqrt(x*x + y*y))), 5) AS lat FROM c")
def a19(spark, sf):
    o = v.origin(spark, sf).withColumn("eid", F.round("depth") % 10)
    return ops.spherical_centroid(o, ["eid"]).select("eid", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("a20_quantile_box", v.with_views("origin") + ", r AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS i, count(*) OVER () AS n FROM origin) SELECT min(lon) FILTER (i = floor(n * 0.05)) AS lo, min(lon) FILTER (i = floor(n * 0.95)) AS hi FROM r")
def a20(spark, sf):
    return ops.rank_quantiles(v.origin(spark, sf), "lon", {"lo": 0.05, "hi": 0.95})


@query("a21_histogram", "SELECT CAST(floor(value / 25.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def a21(spark, sf):
    return ops.histogram(v.table(spark, sf, "events"), "value", 25.0)


@query("a22_absolute_errors", v.with_views("gold", "guess") + "SELECT round(avg(abs(a.t - b.t)), 6) AS mean_abs, round(median(abs(a.t - b.t)), 6) AS median_abs FROM gold a JOIN guess b USING (id)")
def a22(spark, sf):
    e = v.gold(spark, sf).alias("a").join(v.guess(spark, sf).alias("b"), "id").select(F.abs(F.col("a.t") - F.col("b.t")).alias("e"))
    return e.agg(F.round(F.avg("e"), 6).alias("mean_abs")).join(medians(e, [], "e"), how="cross").select("mean_abs", F.round("med", 6).alias("median_abs"))  # single rows


@query("a23_kolmogorov_smirnov", "WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n, 1 - exp(-value / 50) AS c FROM events) SELECT event_type, round(max(greatest(abs(c - i / n), abs(c - (i - 1) / n))), 6) AS d FROM r GROUP BY 1")
def a23(spark, sf):
    return ops.ks_statistic(v.table(spark, sf, "events"), ["event_type"], "value", "event_id", 1 - F.exp(-F.col("value") / 50)).select("event_type", F.round("d", 6).alias("d"))


@query("a24_kernel_density", "WITH g AS (SELECT unnest(generate_series(0, 20)) * 10.0 AS x) SELECT CAST(x AS DOUBLE) AS x, round(sum(exp(-0.5 * pow((x - value) / 8.0, 2))) / (count(*) * 8.0 * sqrt(2 * pi())), 8) AS p FROM g, events GROUP BY x")
def a24(spark, sf):
    grid = spark.range(21).select((F.col("id") * 10.0).alias("x"))
    return ops.kernel_density(v.table(spark, sf, "events"), "value", grid, 8.0).select("x", F.round("p", 8).alias("p"))


@query("a25_location_prior", v.with_views("origin") + ", g AS (SELECT unnest(generate_series(0, 11)) AS i), c AS (SELECT a.i * 30.0 - 165 AS glon, b.i * 15.0 - 82.5 AS glat FROM g a, g b) SELECT CAST(glon AS DOUBLE) AS glon, CAST(glat AS DOUBLE) AS glat, round(sum(exp(-degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat))*sin(radians(glat)) + cos(radians(lat))*cos(radians(glat))*cos(radians(lon)-radians(glon)))))) / 5.0)), 5) AS w FROM c, origin GROUP BY 1, 2")
def a25(spark, sf):
    grid = spark.range(144).select((F.floor(F.col("id") / 12) * 30.0 - 165).alias("glon"), (F.col("id") % 12 * 15.0 - 82.5).alias("glat"))
    return ops.location_prior(v.origin(spark, sf), grid, 5.0).select("glon", "glat", F.round("w", 5).alias("w"))


@query("a26_estimators", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(med), 6) AS center, round(avg(abs(value - med)), 6) AS scale, round(avg(ln(value)), 6) AS mu, round(stddev_pop(ln(value)), 6) AS sigma, round(pow(avg(value), 2) / var_pop(value), 6) AS shape FROM events JOIN m USING (event_type) GROUP BY 1")
def a26(spark, sf):
    return ops.moment_estimates(v.table(spark, sf, "events"), ["event_type"], "value")


@query("f01_in_list", "SELECT orid, mb FROM (" + v.SQL["origin"] + ") WHERE orid IN (3, 5, 8, 13, 21)")
def f01(spark, sf):
    return v.origin(spark, sf).where(F.col("orid").isin(3, 5, 8, 13, 21)).select("orid", "mb")


@query("f02_time_range", f"SELECT event_id FROM events WHERE epoch(ts) >= {START + 10 * 86400 + 3 * 3600} AND epoch(ts) < {START + 10 * 86400 + 15 * 3600}")
def f02(spark, sf):
    start, end = ops.time_range({"training": (START + 10 * 86400, START + 20 * 86400)}, "training", hours=12, skip=3)
    t = F.col("time")
    return v.arrival(spark, sf).where((t >= start) & (t < end)).select(F.col("arid").alias("event_id"))


@query("f03_truncated_between", "SELECT event_id FROM events WHERE value BETWEEN trunc(20.9) AND trunc(40.9)")
def f03(spark, sf):
    return v.table(spark, sf, "events").where(ops.between_truncated("value", 20.9, 40.9)).select("event_id")


@query("f04_box", v.with_views("origin") + "SELECT orid FROM origin WHERE lon > -20 AND lon < 40 AND lat > 0 AND lat < 50")
def f04(spark, sf):
    return v.origin(spark, sf).where(geo.in_box("lon", "lat", -20, 40, 0, 50, strict=True)).select("orid")


@query("f05_date_line_box", v.with_views("origin") + "SELECT orid FROM origin WHERE (lon >= 170 OR lon <= -160) AND lat BETWEEN -30 AND 30")
def f05(spark, sf):
    return v.origin(spark, sf).where(geo.in_box("lon", "lat", 170, -160, -30, 30)).select("orid")


@query("f06_region", v.with_views("origin") + "SELECT orid FROM origin WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -60 AND 60 AND time BETWEEN 800000000 AND 900000000")
def f06(spark, sf):
    return v.origin(spark, sf).where(geo.in_box("lon", "lat", 150, -150, -60, 60) & F.col("time").between(800000000, 900000000)).select("orid")


@query("f07_fit_predicate", v.with_views("assoc") + "SELECT orid, arid FROM assoc WHERE phase IN ('A', 'R') AND orid IN (1, 2, 3, 5, 8, 13) AND orid NOT IN (5) AND timeres BETWEEN 0.0 AND 0.08 AND delta >= 5 AND timedef = 'd'")
def f07(spark, sf):
    p = ops.fit_predicate(phases=["A", "R"], evids=[1, 2, 3, 5, 8, 13], exclude_evids=[5], ranges={"timeres": (0.0, 0.08), "delta": (5, None)}, equal={"timedef": "d"}, evid="orid")
    return v.assoc(spark, sf).where(p).select("orid", "arid")


@query("f08_valid_detections", v.with_views("arrival") + "SELECT arid FROM arrival WHERE delaz > 0 AND delslo > 0 AND snr > 0")
def f08(spark, sf):
    return v.arrival(spark, sf).where(ops.valid_detection()).select("arid")


@query("f10_conditional_projection", v.with_views("site") + "SELECT sta, CASE statype WHEN 'ar' THEN 1 ELSE 0 END AS is_array FROM site")
def f10(spark, sf):
    return v.site(spark, sf).select("sta", F.when(F.col("statype") == "ar", 1).otherwise(0).alias("is_array"))


@query("f11_outlier_bounds", v.with_views("arrival") + ", b AS (SELECT * FROM (VALUES ('click', 5.0, 80.0), ('view', 1.0, 60.0), ('error', 10.0, 200.0)) AS t(iphase, lo, hi)) SELECT arid FROM arrival JOIN b USING (iphase) WHERE amp BETWEEN lo AND hi")
def f11(spark, sf):
    bounds = spark.createDataFrame([("click", 5.0, 80.0), ("view", 1.0, 60.0), ("error", 10.0, 200.0)], "iphase string, lo double, hi double")
    return v.arrival(spark, sf).join(bounds, "iphase").where("amp BETWEEN lo AND hi").select("arid")


@query("f12_sentinels", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 2.0 ELSE value END AS mb, CASE WHEN event_id % 30 = 0 THEN NULL ELSE value END AS depth FROM events")
def f12(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, -999.0).otherwise(F.col("value")).alias("mb"), F.when(F.col("event_id") % 30 == 0, -999.0).otherwise(F.col("value")).alias("depth"))
    return e.select("event_id", ops.sentinel("mb", default=2.0).alias("mb"), ops.sentinel("depth").alias("depth"))


@query("f13_facets_next", "SELECT min(event_id) AS next_id FROM events WHERE event_type = 'error' AND value BETWEEN 10 AND 90 AND event_id > 100")
def f13(spark, sf):
    return ops.next_row(v.table(spark, sf, "events"), "event_id", 100, (F.col("event_type") == "error") & F.col("value").between(10, 90)).select(F.col("event_id").alias("next_id"))


@query("f15_first_match", "SELECT o_custkey, max(o_orderkey) AS modelid FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice = m GROUP BY 1")
def f15(spark, sf):
    return v.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("modelid"))


@query("f16_list_order", "SELECT event_id, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) AS BIGINT) AS place FROM events WHERE event_type IN ('error', 'click', 'view')")
def f16(spark, sf):
    kept = ops.by_list(v.table(spark, sf, "events"), "event_type", ["error", "click", "view"])
    places = sequences.ordinal(kept.select("event_id", "list_place"), [], ["list_place", "event_id"], "place")
    return places.select("event_id", (F.col("place") + 1).alias("place"))


@query("f17_like", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%'")
def f17(spark, sf):
    return v.table(spark, sf, "part").where(F.col("p_name").like("red%")).select("p_partkey")


@query("k01_order", v.with_views("arrival") + "SELECT arid, CAST(row_number() OVER (ORDER BY time, arid) AS BIGINT) AS place FROM arrival")
def k01(spark, sf):
    places = sequences.ordinal(v.arrival(spark, sf).select("arid", "time"), [], ["time", "arid"], "place")
    return places.select("arid", (F.col("place") + 1).alias("place"))


@query("k02_multi_key", v.with_views("site") + "SELECT sta, ondate, CAST(row_number() OVER (ORDER BY statype, ondate DESC, sta) AS BIGINT) AS place FROM site")
def k02(spark, sf):
    places = sequences.ordinal(v.site(spark, sf).select("sta", "statype", "ondate"), [], ["statype", F.desc("ondate"), "sta"], "place")
    return places.select("sta", "ondate", (F.col("place") + 1).alias("place"))


@query("k03_stations_by_distance", v.with_views("site") + ", k AS (SELECT sta, round(degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat))*sin(radians(10.0)) + cos(radians(lat))*cos(radians(10.0))*cos(radians(lon)-radians(20.0)))))), 4) AS d FROM site) SELECT sta, d, CAST(row_number() OVER (ORDER BY d, sta) AS BIGINT) AS place FROM k")
def k03(spark, sf):
    far = v.site(spark, sf).select("sta", F.round(geo.dist_deg_acos("lon", "lat", 20.0, 10.0), 4).alias("d"))
    return sequences.ordinal(far, [], ["d", "sta"], "place").select("sta", "d", (F.col("place") + 1).alias("place"))


@query("k04_top_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def k04(spark, sf):
    return ops.top_n(v.table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("k05_sample")
def k05(spark, sf):
    return ops.sample_rows(v.table(spark, sf, "events"), "event_id", 100, seed=0).select("event_id")


@query("u01_intersection", "SELECT DISTINCT l_orderkey AS evid FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7")
def u01(spark, sf):
    seen = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sta"), F.col("l_orderkey").alias("evid"))
    return ops.seen_by_all(seen, "sta", "evid", [3, 7])


@query("u02_matched_by_both", v.with_views("gold", "guess") + "SELECT id FROM gold WHERE id IN (SELECT id FROM guess WHERE score > 0.5) AND id IN (SELECT id FROM guess WHERE t >= 0)")
def u02(spark, sf):
    g = v.guess(spark, sf)
    return v.gold(spark, sf).select("id").join(g.where("score > 0.5"), "id", "left_semi").join(g.where("t >= 0"), "id", "left_semi")


@query("u03_union", "SELECT l_orderkey AS evid FROM lineitem WHERE l_suppkey = 3 UNION SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7")
def u03(spark, sf):
    seen = v.table(spark, sf, "lineitem")
    return seen.where("l_suppkey = 3").select(F.col("l_orderkey").alias("evid")).union(seen.where("l_suppkey = 7").select("l_orderkey")).distinct()


@query("u04_difference", v.with_views("gold", "guess") + "SELECT id FROM gold WHERE id NOT IN (SELECT id FROM guess)")
def u04(spark, sf):
    return v.gold(spark, sf).select("id").join(v.guess(spark, sf), "id", "left_anti")


@query("u06_concatenate", "SELECT event_id AS id, value FROM events WHERE user_id = 1 UNION ALL SELECT event_id, value FROM events WHERE user_id = 2")
def u06(spark, sf):
    e = v.table(spark, sf, "events")
    return ops.concatenated([e.where(f"user_id = {k}").select(F.col("event_id").alias("id"), "value") for k in (1, 2)])


@query("u07_union_view", "SELECT event_id AS arid FROM events WHERE event_id < 500 UNION ALL SELECT event_id FROM events WHERE event_id >= 9000")
def u07(spark, sf):
    e = v.arrival(spark, sf).select("arid")
    e.where("arid < 500").unionByName(e.where("arid >= 9000")).createOrReplaceTempView("arrival_extended")
    return spark.table("arrival_extended")
