"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import sequences as seq

from . import views as v
from .registry import query


@query("w01_ordinal", v.with_views("arrival") + "SELECT sta, arid, CAST(row_number() OVER (PARTITION BY sta ORDER BY time, arid) - 1 AS BIGINT) AS ordinal FROM arrival")
def w01(spark, sf):
    return seq.ordinal(v.arrival(spark, sf), ["sta"], ["time", "arid"]).select("sta", "arid", "ordinal")


@query("w02_gaps", v.with_views("arrival") + ", g AS (SELECT sta, arid, time - lag(time) OVER (PARTITION BY sta ORDER BY time, arid) AS gap FROM arrival) SELECT sta, arid, round(gap, 3) AS gap FROM g WHERE gap < 3600")
def w02(spark, sf):
    return seq.gaps(v.arrival(spark, sf), ["sta"], "time", "arid").where("gap < 3600").select("sta", "arid", F.round("gap", 3).alias("gap"))


@query("w03_running_roc", v.with_views("gold", "guess") + ", c AS (SELECT score, count(*) FILTER (id % 3 = 0) AS t, count(*) AS n FROM guess GROUP BY 1), r AS (SELECT score, sum(t) OVER (ORDER BY score DESC) AS nt, sum(n) OVER (ORDER BY score DESC) AS na FROM c) SELECT score, CAST(nt AS BIGINT) AS n_true, CAST(na AS BIGINT) AS n_all, round(nt / na, 8) AS precision, round(nt / (SELECT count(*) FROM gold), 8) AS recall FROM r")
def w03(spark, sf):
    g = v.guess(spark, sf).withColumn("hit", F.col("id") % 3 == 0)
    events = v.gold(spark, sf).select(F.count("*")).scalar()
    return seq.running_roc(g, "score", "hit", events).select("score", "n_true", "n_all", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("w04_precision_threshold", v.with_views("guess") + ", c AS (SELECT score, count(*) FILTER (id % 3 = 0) AS t, count(*) AS n FROM guess GROUP BY 1), r AS (SELECT score, sum(t) OVER (ORDER BY score DESC) AS nt, sum(n) OVER (ORDER BY score DESC) AS na FROM c) SELECT min(score) AS score FROM r WHERE nt / na >= 0.72")
def w04(spark, sf):
    g = v.guess(spark, sf).withColumn("hit", F.col("id") % 3 == 0)
    events = v.gold(spark, sf).select(F.count("*")).scalar()
    return seq.running_roc(g, "score", "hit", events).where("precision >= 0.72").agg(F.min("score").alias("score"))


@query("w05_masked_blocks", "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), k AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM r WHERE value > 50) SELECT user_id AS sta, CAST(min(i) AS BIGINT) AS first, CAST(max(i) + 1 AS BIGINT) AS \"end\" FROM k GROUP BY user_id, g")
def w05(spark, sf):
    numbered = seq.ordinal(v.arrival(spark, sf), ["sta"], ["time", "arid"], "i")
    return seq.true_blocks(numbered, ["sta"], "i", F.col("amp") > 50)


@query("w06_merged_blocks", v.with_views("arrival") + ", m AS (SELECT sta, time, time + 600 AS e, max(time + 600) OVER (PARTITION BY sta ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM arrival), k AS (SELECT *, sum(CASE WHEN r IS NULL OR time - r >= 900 THEN 1 ELSE 0 END) OVER (PARTITION BY sta ORDER BY time) AS g FROM m) SELECT sta, CAST(g - 1 AS BIGINT) AS island, round(min(time), 3) AS stime, round(max(e), 3) AS etime, count(*) AS n FROM k GROUP BY sta, g")
def w06(spark, sf):
    blocks = v.arrival(spark, sf).select("sta", F.col("time").alias("stime"), (F.col("time") + 600).alias("etime"))
    return seq.merged_blocks(blocks, ["sta"], "stime", "etime", 900.0).select("sta", "island", F.round("stime", 3).alias("stime"), F.round("etime", 3).alias("etime"), "n")


@query("w07_moving_average", v.with_views("arrival") + "SELECT arid, round(avg(amp) OVER (PARTITION BY sta ORDER BY time, arid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM arrival")
def w07(spark, sf):
    from pyspark.sql import Window

    return v.arrival(spark, sf).select("arid", F.round(F.avg("amp").over(Window.partitionBy("sta").orderBy("time", "arid").rowsBetween(-2, 2)), 6).alias("m"))


@query("w08_sta_lta", v.with_views("arrival") + ", r AS (SELECT arid, row_number() OVER w AS k, avg(amp*amp) OVER (PARTITION BY sta ORDER BY time, arid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, avg(amp*amp) OVER (PARTITION BY sta ORDER BY time, arid ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM arrival WINDOW w AS (PARTITION BY sta ORDER BY time, arid)) SELECT arid, round(CASE WHEN k >= 20 THEN s / l END, 6) AS ratio FROM r")
def w08(spark, sf):
    return seq.sta_lta(v.arrival(spark, sf), ["sta"], ["time", "arid"], "amp", 3, 20).select("arid", F.round("ratio", 6).alias("ratio"))


@query("w09_sliding_windows", "WITH w AS (SELECT event_id, unnest(generate_series(0, 3)) AS k, floor(epoch(ts) / 900) * 900 AS b, value FROM events) SELECT CAST(b - k * 900 AS BIGINT) AS start, count(*) AS n, max(value) AS most FROM w GROUP BY 1")
def w09(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")
    return v.table(spark, sf, "events").groupBy(w).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.unix_timestamp("window.start").alias("start"), "n", "most")


@query("w10_azimuth_gap", v.with_views("arrival") + ", d AS (SELECT DISTINCT sta, azimuth FROM arrival), g AS (SELECT sta, coalesce(lead(azimuth) OVER (PARTITION BY sta ORDER BY azimuth), min(azimuth) OVER (PARTITION BY sta) + 360) - azimuth AS gap FROM d) SELECT sta, max(gap) AS gap FROM g GROUP BY 1")
def w10(spark, sf):
    return seq.azimuth_gap(v.arrival(spark, sf).select("sta", "azimuth").distinct(), ["sta"], "azimuth")


@query("w11_suppression")
def w11(spark, sf):
    return seq.suppress_in_order(v.guess(spark, sf))


@query("w12_fixpoint_suppression")
def w12(spark, sf):
    return seq.suppress_to_fixpoint(v.guess(spark, sf))


@query("w13_best_so_far", v.with_views("arrival") + "SELECT sta, min(arid) AS arid FROM arrival a WHERE amp = (SELECT max(amp) FROM arrival b WHERE b.sta = a.sta) GROUP BY 1")
def w13(spark, sf):
    return v.arrival(spark, sf).groupBy("sta").agg(F.max_by("arid", F.struct("amp", -F.col("arid"))).alias("arid"))


@query("w14_folds")
def w14(spark, sf):
    return seq.folds(v.arrival(spark, sf), "arid", 5).groupBy("fold").agg(F.count("*").alias("n"))
