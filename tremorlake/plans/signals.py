"""Filters, correlations, noise models and stacks of waveforms as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tremorlake.functions import waves
from tremorlake.operators import detection, sequences
from tremorlake.operators import series as ts

from . import views as v
from .registry import query
from .series import wave

_W = "WITH w AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_E = _W + ", e AS (SELECT vec_id, label, CAST(unnest(generate_series(0, 63)) AS BIGINT) AS i, unnest(x) AS x FROM w)"


def _weighted(x="samples"):
    """Sum of samples times their places, which tells any order and any value apart."""
    return F.round(F.aggregate(F.transform(x, lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, b: a + b), 5)


@query("t05_smooth", _E + ", s AS (SELECT a.vec_id, a.i, sum(b.x) / 5 AS y FROM e a JOIN e b ON a.vec_id = b.vec_id AND abs(a.i - b.i) <= 2 GROUP BY ALL) SELECT vec_id, round(sum(y * (i + 1)), 5) AS s FROM s GROUP BY 1")
def t05(spark, sf):
    smooth = ts.map_samples(wave(spark, sf), lambda x, row: (waves.smooth(x, row["srate"], 0.5, "flat")[0],), samples="array<double>")
    return smooth.select("vec_id", _weighted().alias("s"))


@query("t06_band_pass")
def t06(spark, sf):
    return ts.filtered(wave(spark, sf), "freq_1.0_3.0").select("vec_id", _weighted().alias("s"))


@query("t07_envelope", _E + ", h AS (SELECT a.vec_id, a.i, any_value(a.x) AS x, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.x * 2 / 64 / tan(pi() * (a.i - b.i) / 64) ELSE 0 END) AS y FROM e a JOIN e b USING (vec_id) GROUP BY a.vec_id, a.i) SELECT vec_id, round(sum(sqrt(x * x + y * y) * (i + 1)), 4) AS s FROM h GROUP BY 1")
def t07(spark, sf):
    return ts.filtered(wave(spark, sf), "env").select("vec_id", F.round(F.aggregate(F.transform("samples", lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, b: a + b), 4).alias("s"))


@query("t08_decimated")
def t08(spark, sf):
    return ts.filtered(wave(spark, sf), "hz_5").select("vec_id", "srate", F.size("samples").alias("n"))


@query("t09_forced_rate", "SELECT vec_id, 10.0 / 3 AS srate, CAST(22 AS INT) AS n FROM embeddings")
def t09(spark, sf):
    return ts.filtered(wave(spark, sf), "forcehz_3").select("vec_id", "srate", F.size("samples").alias("n"))


@query("t11_arrivals_of_waveforms", v.with_views("arrival") + ", w AS (SELECT DISTINCT sta, floor(time / 86400) * 86400 AS stime FROM arrival) SELECT w.sta, w.stime, count(*) AS n, min(arid) AS first FROM w JOIN arrival a ON a.sta = w.sta AND a.time >= w.stime AND a.time < w.stime + 86400 GROUP BY ALL")
def t11(spark, sf):
    a = v.arrival(spark, sf).select("arid", "sta", "time")
    spans = a.select("sta", (F.floor(F.col("time") / 86400) * 86400).cast("double").alias("stime")).distinct().withColumn("etime", F.col("stime") + 86400)
    with_arrivals = detection.with_arrivals(spans, a, 86400.0)
    return with_arrivals.select("sta", "stime", F.size("arrivals").cast("long").alias("n"), F.array_min(F.col("arrivals.arid")).alias("first"))


@query("t15_mask_blocks", _E + ", g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM e WHERE x > 0), b AS (SELECT vec_id, run, min(i) AS first, max(i) + 1 AS stop FROM g GROUP BY 1, 2) SELECT vec_id, count(*) AS n, sum(first * 100 + stop)::BIGINT AS s FROM b GROUP BY 1")
def t15(spark, sf):
    samples = wave(spark, sf).select("vec_id", F.posexplode("samples").alias("i", "x"))
    blocks = sequences.true_blocks(samples, ["vec_id"], "i", F.col("x") > 0)
    return blocks.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.col("first") * 100 + F.col("end")).cast("long").alias("s"))


# gaps at 3 .. 12 (three samples to its left, four to its right) and 17 .. 24
@query("t16_mirrored_gaps", _W + ", m AS (SELECT vec_id, x, (list_sum(x) - list_sum(x[4:13]) - list_sum(x[18:25])) / 46 AS mean FROM w) SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: i * CASE WHEN i BETWEEN 4 AND 6 THEN x[CAST(7 - i AS BIGINT)] WHEN i BETWEEN 7 AND 9 THEN mean WHEN i BETWEEN 10 AND 13 THEN x[CAST(27 - i AS BIGINT)] WHEN i BETWEEN 18 AND 21 THEN x[CAST(35 - i AS BIGINT)] WHEN i BETWEEN 22 AND 25 THEN x[CAST(51 - i AS BIGINT)] ELSE x[CAST(i AS BIGINT)] END)), 5) AS s FROM m")
def t16(spark, sf):
    masked = wave(spark, sf).withColumn("samples", F.transform("samples", lambda x, i: F.when(~i.between(3, 12) & ~i.between(17, 24), x)))
    return ts.map_samples(masked, lambda x, row: (waves.mirror_missing(x),), samples="array<double>").select("vec_id", _weighted().alias("s"))


@query("t17_stitched_requests", "WITH f AS (SELECT vec_id, label AS sta, vec_id * 40.0 AS t, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT sta, vec_id, CAST(t AS BIGINT) + unnest(generate_series(0, 63)) AS pos, unnest(x) AS x FROM f), l AS (SELECT sta, pos, arg_max(x, vec_id) AS x FROM s GROUP BY 1, 2), r AS (SELECT vec_id AS rid, label AS sta, vec_id * 40 - 20 AS a FROM embeddings) SELECT rid, count(*) AS n, round(sum(x * (pos - a + 1)), 4) AS s FROM r JOIN l ON l.sta = r.sta AND pos >= a AND pos < a + 100 GROUP BY 1")
def t17(spark, sf):
    files = wave(spark, sf).select(F.col("label").alias("sta"), F.lit("Z").alias("chan"), (F.col("vec_id") * 40.0).alias("time"), F.lit(1.0).alias("srate"), "samples")
    requests = wave(spark, sf).select(F.col("vec_id").alias("rid"), F.col("label").alias("sta"), F.lit("Z").alias("chan"), (F.col("vec_id") * 40.0 - 20).alias("stime"), (F.col("vec_id") * 40.0 + 80).alias("etime"))
    got = ts.stitched(requests, files)
    total = F.aggregate(F.transform("samples", lambda s, i: F.coalesce(s, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return got.select("rid", F.size(F.filter("samples", lambda x: x.isNotNull())).cast("long").alias("n"), F.round(total, 4).alias("s"))


_PAIRS = _E + ", p AS (SELECT a.vec_id, a.i, b.i AS j, a.x AS a, b.x AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


@query("t19_standardised_xcorr", _E + ", m AS (SELECT vec_id, avg(x) AS mean, avg(x) FILTER (i < 16) AS tmean FROM e GROUP BY 1), t AS (SELECT vec_id, i, x - tmean AS t FROM e JOIN m USING (vec_id) WHERE i < 16), b AS (SELECT vec_id - 1 AS vec_id, i, x - mean AS b FROM e JOIN m USING (vec_id)), l AS (SELECT vec_id, b.i - t.i AS lag, sum(t * b) / sqrt(sum(t * t) * sum(b * b)) AS xc FROM t JOIN b USING (vec_id) WHERE b.i - t.i BETWEEN 0 AND 48 GROUP BY 1, 2) SELECT vec_id, round(max(xc), 5) AS xc, arg_max(lag, xc) AS lag FROM l GROUP BY 1")
def t19(spark, sf):
    a = wave(spark, sf)
    both = a.select((F.col("vec_id") - 1).alias("vec_id"), "samples").join(a.select("vec_id", F.slice("samples", 1, 16).alias("template")), "vec_id")
    got = ts.map_samples(both, lambda x, row: waves.standardised_correlation(row["template"], x)[:2], xc="double", lag="int")
    return got.select("vec_id", F.round("xc", 5).alias("xc"), F.col("lag").cast("long").alias("lag"))


@query("t20_best_shift", _PAIRS + ", l AS (SELECT vec_id, i - j AS k, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS xc FROM p WHERE i - j BETWEEN -5 AND 5 GROUP BY 1, 2) SELECT vec_id, round(max(xc), 5) AS xc, arg_max(k, xc) AS shift FROM l GROUP BY 1")
def t20(spark, sf):
    from .series import _pairs

    return ts.best_correlation(_pairs(spark, sf).select("vec_id", "samples", "other"), 5).select("vec_id", F.round("xc", 5).alias("xc"), F.col("shift").cast("long").alias("shift"))


@query("t22_sta_lta_sum", _E + ", r AS (SELECT vec_id, i, avg(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS 3 PRECEDING) AS sta, avg(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS 15 PRECEDING) AS lta FROM e) SELECT vec_id, round(sum(sta / lta * i), 4) AS s FROM r WHERE i >= 15 GROUP BY 1")
def t22(spark, sf):
    ratio = ts.map_samples(wave(spark, sf), lambda x, row: (waves.sta_lta(x, 4, 16),), samples="array<double>")
    return ratio.select("vec_id", F.round(F.aggregate(F.transform("samples", lambda s, i: s * i), F.lit(0.0), lambda a, b: a + b), 4).alias("s"))


@query("t23_doublets", _E + ", f AS (SELECT label, vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM w), d AS (SELECT * FROM f WHERE (other - vec_id) * 20.0 >= 60), l AS (SELECT d.vec_id, d.other, a.i - b.i AS k, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS xc FROM d JOIN e a ON a.vec_id = d.vec_id JOIN e b ON b.vec_id = d.other WHERE a.i < 32 AND b.i < 32 AND a.i - b.i BETWEEN -3 AND 3 GROUP BY ALL) SELECT vec_id, other, round(max(xc), 5) AS xc, arg_max(k, xc) AS shift FROM l GROUP BY 1, 2")
def t23(spark, sf):
    events = wave(spark, sf).select("label", F.col("vec_id").alias("evid"), (F.col("vec_id") * 20.0).alias("atime"), F.slice("samples", 1, 32).alias("samples"))
    got = detection.doublets(events, ["label"], 60.0, 3)
    return got.select(F.col("evid").alias("vec_id"), "other", F.round("xc", 5).alias("xc"), F.col("shift").cast("long").alias("shift"))


@query("t25_ar_order")
def t25(spark, sf):
    return ts.map_samples(wave(spark, sf), lambda x, row: (waves.ar_order(x, 4),), order="int").select("vec_id", "order")


@query("t26_ar_likelihood", _E + ", r AS (SELECT a.vec_id, a.x - 0.5 * lag(a.x) OVER w + 0.2 * lag(a.x, 2) OVER w AS err, i FROM e a WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, round(sum(-0.5 * err * err / 0.01 - ln(0.1 * sqrt(2 * pi()))), 4) AS ll FROM r WHERE i >= 2 GROUP BY 1")
def t26(spark, sf):
    ll = ts.map_samples(wave(spark, sf), lambda x, row: (waves.ar_fast_log_likelihood(x, 0.0, np.array([0.5, -0.2]), 0.1),), ll="double")
    return ll.select("vec_id", F.round("ll", 4).alias("ll"))


@query("t27_ar_spectrum", "WITH f AS (SELECT event_id, event_id % 50 / 100.0 AS f FROM events) SELECT event_id, round(0.01 / (pow(1 - 0.5 * cos(2 * pi() * f) + 0.2 * cos(4 * pi() * f), 2) + pow(0.5 * sin(2 * pi() * f) - 0.2 * sin(4 * pi() * f), 2)), 6) AS power FROM f")
def t27(spark, sf):
    frequency = v.table(spark, sf, "events").select("event_id", F.array((F.col("event_id") % 50) / 100.0).alias("samples"))
    power = ts.map_samples(frequency, lambda x, row: (waves.ar_spectrum(np.array([0.5, -0.2]), 0.1, x),), samples="array<double>")
    return power.select("event_id", F.round(F.get("samples", 0), 6).alias("power"))


@query("t27_ar_autocovariance", "WITH m AS (SELECT c_custkey AS id, c_custkey % 11 / 20.0 AS p1, -(c_custkey % 7) / 20.0 AS p2 FROM customer), r AS (SELECT id, p1, p2, 0.01 * (1 - p2) / ((1 + p2) * (pow(1 - p2, 2) - pow(p1, 2))) AS r0 FROM m) SELECT id, round(r0, 6) AS r0, round(p1 * r0 / (1 - p2), 6) AS r1, round(p1 * p1 * r0 / (1 - p2) + p2 * r0, 6) AS r2, true AS stationary FROM r")
def t27b(spark, sf):
    id_ = F.col("c_custkey")
    models = v.table(spark, sf, "customer").select(id_.alias("id"), F.array((id_ % 11 / 20).cast("double"), (-(id_ % 7) / 20).cast("double")).alias("samples"))
    got = ts.map_samples(models, lambda x, row: (waves.ar_autocovariance(x, 0.1, 2), float(waves.ar_is_stationary(x))), r="array<double>", ok="double")
    return got.select("id", *(F.round(F.get("r", k), 6).alias(f"r{k}") for k in range(3)), (F.col("ok") > 0).alias("stationary"))


@query("t29_recent_noise_model", v.with_views("arrival") + ", b AS (SELECT sta, floor(time / 7200) AS blk, avg(amp) AS loc, stddev_pop(amp) AS scale, bool_or(iphase = 'error') AS bad FROM arrival GROUP BY 1, 2), r AS (SELECT arid, sta, time FROM arrival WHERE iphase = 'purchase'), m AS (SELECT arid, r.sta, max(blk) AS blk FROM r JOIN b ON b.sta = r.sta AND NOT bad AND (blk + 1) * 7200 <= r.time GROUP BY 1, 2) SELECT r.arid, CAST(m.blk * 7200 AS DOUBLE) AS stime, round(loc, 5) AS loc, round(scale, 5) AS scale FROM r LEFT JOIN m ON m.arid = r.arid LEFT JOIN b ON b.sta = m.sta AND b.blk = m.blk")
def t29(spark, sf):
    a = v.arrival(spark, sf)
    requests = a.where("iphase = 'purchase'").select("arid", "sta", "time")
    got = detection.recent_noise(requests, a.select("sta", "time", "amp", (F.col("iphase") == "error").alias("unsafe")), 7200.0)
    return got.select("arid", "stime", F.round("loc", 5).alias("loc"), F.round("scale", 5).alias("scale"))


@query("t33_fourier_features", "WITH e AS (SELECT event_id, value / 100 AS a1, (event_id % 7) / 7.0 AS p1, 0.5 AS a2, (event_id % 11) / 11.0 AS p2, unnest(generate_series(0, 19)) AS i FROM events) SELECT event_id, round(sum((a1 * cos(2 * pi() * (i / 10.0 * 0.5 + p1)) + a2 * cos(2 * pi() * (i / 10.0 * 1.0 + p2))) * (i + 1)), 5) AS s FROM e GROUP BY 1")
def t33(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", F.array(F.col("value") / 100, F.lit(0.5)).alias("amps"), F.array(F.col("event_id") % 7 / 7.0, F.col("event_id") % 11 / 11.0).alias("phases"))
    return e.select("event_id", _weighted(detection.fourier_signal("amps", "phases", 20, 10.0)).alias("s"))


@query("t36_convolved_likelihood", _E + ", k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([0.1, 0.2, 0.4, 0.2, 0.1]) AS c), s AS (SELECT vec_id, i + d AS i, sum(x * c) AS y FROM e, k GROUP BY 1, 2) SELECT vec_id, round(sum(y * (i + 1)), 5) AS s FROM s WHERE i BETWEEN 0 AND 63 GROUP BY 1")
def t36(spark, sf):
    return wave(spark, sf).select("vec_id", _weighted(detection.convolved("samples", [0.1, 0.2, 0.4, 0.2, 0.1])).alias("s"))


@query("t37_signal_log_odds", _E + ", t AS (SELECT unnest(generate_series(0, 3)) AS j, unnest([0.1, 0.3, 0.2, 0.1]) AS t), l AS (SELECT vec_id, i - j AS lag, sum(x * t - t * t / 2) / 0.04 AS odds, count(*) AS n FROM e, t GROUP BY 1, 2) SELECT vec_id, round(max(odds), 5) AS odds, arg_max(lag, odds) AS lag FROM l WHERE n = 4 GROUP BY 1")
def t37(spark, sf):
    got = ts.map_samples(wave(spark, sf), lambda x, row: waves.best_log_odds(x, np.array([0.1, 0.3, 0.2, 0.1]), 0.2), odds="double", lag="int")
    return got.select("vec_id", F.round("odds", 5).alias("odds"), F.col("lag").cast("long").alias("lag"))


@query("t38_slowness_scan", _E + ", s AS (SELECT unnest(generate_series(-2, 2)) AS slow), b AS (SELECT label, slow, i - slow * (vec_id % 4) AS pos, sum(x) AS y FROM e, s GROUP BY ALL) SELECT label, slow AS slowness, round(sum(y * y), 4) AS power FROM b WHERE pos BETWEEN 0 AND 63 GROUP BY 1, 2")
def t38(spark, sf):
    elements = wave(spark, sf).select("label", (F.col("vec_id") % 4).alias("offset"), "samples")
    return detection.slowness_scan(elements, ["label"], "offset", [-2, -1, 0, 1, 2]).select("label", "slowness", F.round("power", 4).alias("power"))


@query("t39_spectrum_lines", _E + ", k AS (SELECT unnest(generate_series(0, 32)) AS k), d AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS c, sum(x * sin(2 * pi() * k * i / 64)) AS s FROM e, k GROUP BY 1, 2) SELECT vec_id, round(sum((c * c + s * s) / 64 * (k + 1)), 4) AS s FROM d GROUP BY 1")
def t39(spark, sf):
    power = ts.spectrum(wave(spark, sf))
    return power.select("vec_id", F.round(F.aggregate(F.transform("power", lambda p, k: p * (k + 1)), F.lit(0.0), lambda a, b: a + b), 4).alias("s"))
