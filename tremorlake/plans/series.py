"""Time-series queries over the embeddings' vectors as waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import series as ts
from tremorlake.operators.ranks import medians

from . import views as v
from .registry import query

_W = "WITH w AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) "


def wave(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0.0).alias("stime"), F.lit(10.0).alias("srate"), F.col("embedding").cast("array<double>").alias("samples"))


@query("t01_filter_chain")
def t01(spark, sf):
    return ts.filtered(wave(spark, sf), "freq_1.0_3.0;env;smooth_1.5;hz_5")


@query("t02_canonical_chain")
def t02(spark, sf):
    return ts.filtered(wave(spark, sf), "hz_5;env;center;freq_1.0_3.0", canonical=True)


@query("t03_center", _W + "SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v - list_avg(x)))), 6) AS s FROM w")
def t03(spark, sf):
    c = wave(spark, sf).select("vec_id", ts.centered().alias("c"))
    return c.select("vec_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("s"))


@query("t04_log", _W + "SELECT vec_id, CAST(len(list_filter(x, lambda v: v > 0)) AS BIGINT) AS n, round(list_sum(list_transform(list_filter(x, lambda v: v > 0), lambda v: ln(v))), 5) AS s FROM w")
def t04(spark, sf):
    c = wave(spark, sf).select("vec_id", F.filter(ts.logged(), lambda x: x.isNotNull()).alias("c"))
    return c.select("vec_id", F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@query("t10_slice", _W + "SELECT vec_id, CAST(len(x[11:30]) AS BIGINT) AS n, round(list_sum(x[11:30]), 6) AS s FROM w")
def t10(spark, sf):
    c = wave(spark, sf).select("vec_id", ts.sliced(F.lit(1.0), F.lit(3.0)).alias("c"))
    return c.select("vec_id", F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("t12_fraction_valid", _W + "SELECT vec_id, round(len(list_filter(x, lambda v: v > -0.1)) / 64.0, 6) AS f FROM w")
def t12(spark, sf):
    masked = wave(spark, sf).withColumn("samples", F.transform("samples", lambda x: F.when(x > -0.1, x)))
    return masked.select("vec_id", F.round(ts.fraction_valid(), 6).alias("f"))


_PAIR = _W + ", p AS (SELECT a.vec_id, a.x AS a, b.x AS b FROM w a JOIN w b ON b.vec_id = a.vec_id + 1) "


def _pairs(spark, sf):
    a = wave(spark, sf)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("other")), "vec_id")


@query("t13_l1_distance", _PAIR + "SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2]))), 5) AS d FROM p")
def t13(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(ts.l1_distance("samples", "other"), 5).alias("d"))


@query("t16_mirror_missing")
def t16(spark, sf):
    masked = wave(spark, sf).withColumn("samples", F.transform("samples", lambda x, i: F.when((i < 20) | (i >= 30), x)))
    return ts.filtered(masked, "freq_1.0_3.0")


@query("t18_xcorr", _PAIR + "SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 5) AS xc FROM p")
def t18(spark, sf):
    d = _pairs(spark, sf).select("vec_id", ts.dot("samples", "other").alias("ab"), ts.dot("samples", "samples").alias("aa"), ts.dot("other", "other").alias("bb"))
    return d.select("vec_id", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 5).alias("xc"))


@query("t20_shifted_xcorr")
def t20(spark, sf):
    return ts.best_correlation(_pairs(spark, sf).select("vec_id", "samples", "other"), 5).select("vec_id", F.round("xc", 6).alias("xc"), "shift")


@query("t21_template_detector")
def t21(spark, sf):
    w = wave(spark, sf)
    # the library: the first 16 samples of one vector of each label
    library = w.groupBy("label").agg(F.min_by(F.slice("samples", 1, 16), "vec_id").alias("t")).orderBy("label").collect()
    return ts.correlations(w.select("vec_id", "samples"), [(r["label"], r["t"]) for r in library], 0.6)


@query("t24_ar_model")
def t24(spark, sf):
    return ts.ar_models(wave(spark, sf), 2).select("vec_id", "phi", "sigma", "loglik")


@query("t28_l1_noise_model", _W + ", e AS (SELECT label, unnest(x) AS v FROM w), m AS (SELECT label, median(v) AS loc FROM e GROUP BY 1) SELECT label, round(min(loc), 6) AS loc, round(avg(abs(v - loc)), 6) AS scale FROM e JOIN m USING (label) GROUP BY 1")
def t28(spark, sf):
    e = wave(spark, sf).select("label", F.explode("samples").alias("v"))
    m = medians(e, ["label"], "v", "loc")
    return e.join(m, "label").groupBy("label").agg(F.round(F.min("loc"), 6).alias("loc"), F.round(F.avg(F.abs(F.col("v") - F.col("loc"))), 6).alias("scale"))


@query("t30_envelope_template", "WITH e AS (SELECT event_id, exp(0.5) * 2 AS peak, value / 50 AS h FROM events), s AS (SELECT event_id, peak, h, unnest(generate_series(0, 19)) AS i FROM e) SELECT event_id, round(sum(CASE WHEN i = 0 THEN -7.0 WHEN i < floor(peak) + 1 THEN ln(i * exp(h) / peak + exp(-7.0)) ELSE (i - peak) / 2 * -exp(-3.0) + h END), 5) AS total FROM s GROUP BY 1")
def t30(spark, sf):
    e = v.table(spark, sf, "events")
    t = ts.envelope_template(F.lit(0.0), F.lit(0.5), F.col("value") / 50, F.lit(-3.0), 2.0, 10)
    return e.select("event_id", F.round(F.aggregate(t, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("t31_predicted_signal", "WITH s AS (SELECT user_id AS sta, floor(epoch(ts) / 3600) AS h, unnest(generate_series(0, 4)) AS i, value FROM events) SELECT sta, CAST(h + i AS BIGINT) AS idx, round(sum(value * exp(-i)), 5) AS v FROM s GROUP BY 1, 2")
def t31(spark, sf):
    e = v.arrival(spark, sf).select("sta", F.floor(F.col("time") / 3600).alias("h"), "amp", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.exp(-i.cast("double")))).alias("i", "w"))
    return e.groupBy("sta", (F.col("h") + F.col("i")).cast("bigint").alias("idx")).agg(F.round(F.sum(F.col("amp") * F.col("w")), 5).alias("v"))


@query("t34_block_means", _W + "SELECT vec_id, round(list_sum(list_transform(generate_series(0, 5), lambda i: abs(list_avg(x[CAST(i*10+1 AS BIGINT):CAST(i*10+10 AS BIGINT)])))), 6) AS s FROM w")
def t34(spark, sf):
    c = wave(spark, sf).select("vec_id", ts.block_means("samples", 10).alias("c"))
    return c.select("vec_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("s"))


@query("t35_shifted_sum", _PAIR + "SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(a[i] + CASE WHEN i > 3 THEN b[i - 3] ELSE 0.5 END))), 5) AS s FROM p")
def t35(spark, sf):
    c = _pairs(spark, sf).select("vec_id", ts.shifted_sum("samples", "other", 3, 0.5).alias("c"))
    return c.select("vec_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("s"))


@query("t39_power_spectrum")
def t39(spark, sf):
    return ts.spectrum(wave(spark, sf)).select("vec_id", "power")


@query("t22_sta_lta_array")
def t22(spark, sf):
    from tremorlake.functions import waves

    return ts.map_samples(wave(spark, sf), lambda x, row: (waves.sta_lta(x, 4, 16),), ratio="array<double>").select("vec_id", "ratio")
