"""Evaluation of bulletins, models and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import matching, models

from . import views as v
from .registry import query

_MATCH = v.with_views("gold", "guess")


@query("m01_matching", _MATCH + ", e AS (SELECT a.id, b.id AS gid FROM gold a JOIN guess b ON abs(a.t - b.t) <= 50 AND abs(a.lat - b.lat) <= 1 AND a.id = b.id) SELECT count(*) AS matched FROM e")
def m01(spark, sf):
    return matching.matched(v.gold(spark, sf), v.guess(spark, sf)).agg(F.count("*").alias("matched"))


@query("m02_precision_recall")
def m02(spark, sf):
    gold, guess = v.gold(spark, sf), v.guess(spark, sf)
    return matching.precision_recall(gold, guess, matching.matched(gold, guess))


@query("m04_recalibration", _MATCH + "SELECT round(regr_slope(a.mb, b.score), 6) AS slope, round(regr_intercept(a.mb, b.score), 6) AS intercept FROM gold a JOIN guess b USING (id)")
def m04(spark, sf):
    both = v.gold(spark, sf).join(v.guess(spark, sf).select("id", "score"), "id")
    return matching.recalibrated(both, "score", "mb").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("m07_linear_fits", "SELECT event_type, count(*) AS n, round(regr_slope(value, event_id % 17), 4) AS slope FROM events GROUP BY 1")
def m07(spark, sf):
    e = v.table(spark, sf, "events")
    fit = models.linear_fits(e, ["event_type"], {"one": F.lit(1.0), "x": F.col("event_id") % 17}, "value", prior=1e-9)
    return fit.select("event_type", "n", F.round(F.element_at("coefficients", 2), 4).alias("slope"))


@query("m08_gaussian_process")
def m08(spark, sf):
    e = v.arrival(spark, sf).select("sta", "azimuth", "amp")
    return models.gaussian_process(e, ["sta"], [0.0, 90.0, 180.0, 270.0], "azimuth", "amp", 45.0, 1.0)


def _refit(k):
    """Views of the k-th round: the line f<k> through the rows k<k>, and what is left for the next one."""
    return (
        f"f{k} AS (SELECT iphase, regr_slope(amp, slow) AS slope, regr_intercept(amp, slow) AS intercept FROM k{k} GROUP BY 1), "
        f"r{k} AS (SELECT iphase, slow, amp, amp - slope * slow - intercept AS r FROM arrival JOIN f{k} USING (iphase)), "
        f"k{k + 1} AS (SELECT iphase, slow, amp FROM r{k} JOIN (SELECT iphase, stddev_pop(r) AS d FROM r{k} GROUP BY 1) USING (iphase) WHERE abs(r) <= 3 * d)"
    )


@query("m09_robust_line", v.with_views("arrival") + ", k0 AS (SELECT iphase, slow, amp FROM arrival), " + ", ".join(map(_refit, range(3))) + " SELECT iphase, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM f2")
def m09(spark, sf):
    fit = models.robust_line(v.arrival(spark, sf), ["iphase"], "slow", "amp")
    return fit.select("iphase", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("m10_clusters")
def m10(spark, sf):
    return models.clusters(v.origin(spark, sf).select("orid", "lon", "lat", "depth"), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("m11_detection_model")
def m11(spark, sf):
    rows = v.origin(spark, sf).select("mb", "depth", (F.col("orid") % 90).cast("double").alias("dist"), ((F.col("mb") - F.col("orid") % 90 / 45) > 3).alias("seen"))
    model = models.detection_model(rows, "seen")
    return spark.createDataFrame(sorted(model.items()), "name string, weight double")


@query("m16_cross_validation")
def m16(spark, sf):
    return models.cross_validated(v.arrival(spark, sf), "arid", "slow", "amp")


@query("m18_nearest_values", "WITH q AS (SELECT s_suppkey AS qid, s_suppkey * 100 + 0.25 AS qx FROM supplier), c AS (SELECT qid, value, row_number() OVER (PARTITION BY qid ORDER BY abs(event_id - qx), event_id) AS k FROM q JOIN events ON abs(event_id - qx) <= 20) SELECT qid, round(avg(value), 6) AS value, count(*) AS n FROM c WHERE k <= 5 GROUP BY 1")
def m18(spark, sf):
    rows = v.table(spark, sf, "events").select(F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    places = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") * 100 + 0.25).cast("double").alias("qx"))
    return models.nearest_values(rows, places, "x", "qx", "y", 20.0, 5).select("qid", F.round("value", 6).alias("value"), "n")


@query("m20_hough", "WITH s AS (SELECT s_suppkey AS sta, (s_suppkey * 37 % 360 - 180.0) AS slon, (s_suppkey * 17 % 181 - 90.0) AS slat FROM supplier), c AS (SELECT unnest(generate_series(0, 71)) AS cell), p AS (SELECT sta, cell, slon, slat, cell % 12 * 30.0 - 165 AS clon, floor(cell / 12) * 30.0 - 75 AS clat FROM s, c), tt AS (SELECT sta, cell, radians(degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(clat)-radians(slat))/2),2) + cos(radians(clat))*cos(radians(slat))*pow(sin((radians(clon)-radians(slon))/2),2))))))) * 6371.0 / 8.0 AS tt FROM p), o AS (SELECT a.user_id AS sta, event_type AS phase, cell, epoch(ts) - tt AS t0 FROM events a JOIN tt ON tt.sta = a.user_id), n AS (SELECT *, CAST(floor(t0 / 10) AS BIGINT) + unnest([-1, 0, 1]) AS tbin FROM o), q AS (SELECT *, (tbin + 1) * 10 - t0 AS zb, tbin * 10 - t0 AS za FROM n), m AS (SELECT cell, tbin, sta, phase, ln(greatest((CASE WHEN zb < 0 THEN 0.5*exp(zb/5.0) ELSE 1-0.5*exp(-zb/5.0) END) - (CASE WHEN za < 0 THEN 0.5*exp(za/5.0) ELSE 1-0.5*exp(-za/5.0) END), 1e-12)) - ln(10) + 8 AS s FROM q), b AS (SELECT cell, tbin, sta, phase, max(s) AS s FROM m WHERE s > 0 GROUP BY ALL) SELECT CAST(cell AS BIGINT) AS cell, tbin, round(sum(s), 4) AS score, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 2")
def m20(spark, sf):
    stations = v.site(spark, sf).select("sta", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    templates = v.arrival(spark, sf).select("sta", F.col("iphase").alias("phase"), F.col("time").alias("atime"))
    return models.event_grid(templates, stations, 30.0, 30.0, 10.0).where("n >= 2").select(F.col("cell").cast("bigint").alias("cell"), "tbin", F.round("score", 4).alias("score"), "n")


@query("m21_bin_index", v.with_views("origin") + "SELECT orid, CAST(least(floor(depth / 50.0 + 1e-8), 13) AS BIGINT) AS b FROM origin WHERE depth BETWEEN 0 AND 700")
def m21(spark, sf):
    return v.origin(spark, sf).where("depth BETWEEN 0 AND 700").select("orid", models.bin_index("depth", 0.0, 50.0, 14).alias("b"))


@query("m22_locations")
def m22(spark, sf):
    from tremorlake.functions import geo
    from tremorlake.operators.sequences import ordinal

    # picks of up to twelve stations an event, all over the network
    stations = ordinal(v.site(spark, sf).select("sta", F.col("lon").alias("slon"), F.col("lat").alias("slat")), [], ["sta"], "k")
    n = v.table(spark, sf, "supplier").select(F.count("*")).scalar()
    events = v.gold(spark, sf).select(F.col("id").alias("evid"), "lon", "lat")
    picks = events.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("k", F.pmod(F.col("evid") * 31 + F.floor(F.col("j") * n / 12), n))
    seen = picks.dropDuplicates(["evid", "k"]).join(stations, "k")
    return models.located(seen.select("evid", "slon", "slat", (geo.dist_km("lon", "lat", "slon", "slat") / 8.0).alias("atime"))).select("evid", F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"))


@query("m26_block_chains")
def m26(spark, sf):
    blocks = v.arrival(spark, sf).groupBy(F.floor(F.col("time") / 86400).alias("block")).agg(F.count("*").alias("n"))
    return models.run_blocks(blocks.select("block", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"), "n", F.lit(86400.0).alias("seconds")))


@query("w15_precision_curve")
def w15(spark, sf):
    gold, guess = v.gold(spark, sf), v.guess(spark, sf)
    return matching.curve(guess, matching.matched(gold, guess), gold.count())


#: Bounds so wide that many candidates compete. Of a component all matchings are listed; it has c pairs from the greatest score on at which all guesses of a matching of c pairs are there.
_WIDE = v.with_views("gold", "guess").replace("WITH ", "WITH RECURSIVE ", 1) + """, q AS (SELECT DISTINCT ON (id) id, t, lon, lat, score FROM guess ORDER BY id, t, lon, lat, score),
e AS (SELECT a.id, b.id AS gid, score FROM gold a JOIN q b ON abs(a.t - b.t) <= 400 WHERE degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(a.lat)-radians(b.lat))/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(a.lon)-radians(b.lon))/2),2)))))) <= 60),
l AS (SELECT id * 2 AS x, gid * 2 + 1 AS y FROM e UNION ALL SELECT gid * 2 + 1, id * 2 FROM e),
reached AS (SELECT x, x AS origin FROM l UNION SELECT y, origin FROM reached JOIN l USING (x) WHERE origin < y),
k AS (SELECT id, gid, score, comp, row_number() OVER (PARTITION BY comp ORDER BY id, gid) AS k FROM e JOIN (SELECT x, min(origin) AS comp FROM reached GROUP BY x) ON x = id * 2),
states AS (SELECT comp, k, [id] AS ids, [gid] AS gids, score AS s, 1::BIGINT AS c FROM k
    UNION ALL SELECT comp, k.k, list_append(ids, id), list_append(gids, gid), least(s, score), c + 1 FROM states JOIN k USING (comp) WHERE k.k > states.k AND NOT list_contains(ids, id) AND NOT list_contains(gids, gid)),
h AS (SELECT comp, c, max(s) AS score FROM states GROUP BY comp, c), n AS (SELECT score, count(*) AS t FROM h GROUP BY score), m AS (SELECT score, count(*) AS n FROM q GROUP BY score),
r AS (SELECT score, sum(coalesce(t, 0)) OVER (ORDER BY score DESC) AS nt, sum(n) OVER (ORDER BY score DESC) AS na FROM m LEFT JOIN n USING (score))
SELECT score, CAST(nt AS BIGINT) AS n_true, CAST(na AS BIGINT) AS n_all, round(nt / na, 8) AS precision, round(nt / (SELECT count(*) FROM gold), 8) AS recall FROM r"""


@query("w15_exact_curve", _WIDE)
def w15_exact(spark, sf):
    every = v.guess(spark, sf)
    first = every.groupBy("id").agg(F.min(F.struct("t", "lon", "lat", "score")).alias("g")).select("id", "g.*")
    got = matching.exact_curve(v.gold(spark, sf), first, 400.0, 60.0)
    return got.select("score", "n_true", "n_all", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))
