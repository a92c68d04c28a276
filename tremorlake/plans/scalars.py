"""Scalar functions over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import dist, geo, names, source

from . import views as v
from .registry import query

_D = "degrees(2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians(lat)-radians(lat2))/2),2) + cos(radians(lat))*cos(radians(lat2))*pow(sin((radians(lon)-radians(lon2))/2),2))))))"
_PTS = v.with_views("origin") + ", p AS (SELECT orid, lon, lat, lat * 1.5 AS lon2, lon / 2.5 AS lat2, mb, depth, time FROM origin) "


def _points(spark, sf):
    return v.origin(spark, sf).select("orid", "lon", "lat", (F.col("lat") * 1.5).alias("lon2"), (F.col("lon") / 2.5).alias("lat2"), "mb", "depth", "time")


PT = ("lon", "lat", "lon2", "lat2")


@query("x01_dist_deg", _PTS + f"SELECT orid, round({_D}, 6) AS d FROM p")
def x01(spark, sf):
    return _points(spark, sf).select("orid", F.round(geo.dist_deg(*PT), 6).alias("d"))


@query("x02_dist_deg_acos", _PTS + "SELECT orid, round(degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat))*sin(radians(lat2)) + cos(radians(lat))*cos(radians(lat2))*cos(radians(lon)-radians(lon2)))))), 5) AS d FROM p")
def x02(spark, sf):
    return _points(spark, sf).select("orid", F.round(geo.dist_deg_acos(*PT), 5).alias("d"))


@query("x03_dist_km", _PTS + f"SELECT orid, round(radians({_D}) * 6371.0, 4) AS km FROM p")
def x03(spark, sf):
    return _points(spark, sf).select("orid", F.round(geo.dist_km(*PT), 4).alias("km"))


@query("x04_degdiff", _PTS + ", q AS (SELECT orid, fmod(fmod(lat2 - lon, 360.0) + 360.0, 360.0) AS d FROM p) SELECT orid, round(CASE WHEN d > 180 THEN d - 360 ELSE d END, 6) AS d FROM q")
def x04(spark, sf):
    return _points(spark, sf).select("orid", F.round(geo.degdiff("lon", "lat2"), 6).alias("d"))


@query("x05_azimuth", _PTS + f", q AS (SELECT *, sin(radians({_D})) AS s FROM p), r AS (SELECT *, degrees(acos(least(1.0, greatest(-1.0, (sin(radians(lat2))*cos(radians(lat)) - cos(radians(lat2))*sin(radians(lat))*cos(radians(lon2)-radians(lon))) / nullif(s, 0))))) AS z FROM q) SELECT orid, round(CASE WHEN sin(radians(lon2)-radians(lon)) >= 0 THEN z ELSE 360 - z END, 4) AS azi FROM r WHERE s > 0.001")
def x05(spark, sf):
    return _points(spark, sf).where(F.sin(F.radians(geo.dist_deg(*PT))) > 0.001).select("orid", F.round(geo.azimuth(*PT), 4).alias("azi"))


def signed_round(c, digits: int):
    """round(c) as SQL has it: what is rounded to zero keeps its sign, which Spark's doesn't."""
    r = F.round(c, digits)
    return F.when((c < 0) & (r == 0), F.lit(-0.0)).otherwise(r)


@query("x06_destination", _PTS + ", q AS (SELECT orid, radians(lat) AS a, radians(depth) AS w, (mb * 500) / 6371.0 AS d, lon FROM p), r AS (SELECT *, asin(least(1.0, greatest(-1.0, sin(a)*cos(d) + cos(a)*sin(d)*cos(w)))) AS y FROM q), s AS (SELECT *, lon + degrees(atan2(sin(w)*sin(d)*cos(a), cos(d) - sin(a)*sin(y))) + 180 AS x FROM r) SELECT orid, round(fmod(fmod(x, 360.0) + 360.0, 360.0) - 180, 5) AS lon2, round(degrees(y), 5) AS lat2 FROM s WHERE abs(a) < 1.55")
def x06(spark, sf):
    lon, lat = geo.destination("lon", "lat", "depth", F.col("mb") * 500)
    return _points(spark, sf).where(F.abs(F.radians("lat")) < 1.55).select("orid", signed_round(lon, 5).alias("lon2"), signed_round(lat, 5).alias("lat2"))


@query("x07_lonlat_text", _PTS + "SELECT orid, printf('%.2f', abs(lon)) || CASE WHEN lon < 0 THEN ' W ' ELSE ' E ' END || printf('%.2f', abs(lat)) || CASE WHEN lat < 0 THEN ' S' ELSE ' N' END AS place FROM p")
def x07(spark, sf):
    return _points(spark, sf).select("orid", geo.lonlat_text("lon", "lat").alias("place"))


@query("x08_trunc", "SELECT event_id, trunc((value - 100) * 10.0) / 10.0 AS v FROM events")
def x08(spark, sf):
    return v.table(spark, sf, "events").select("event_id", names.trunc_digits(F.col("value") - 100, 1).alias("v"))


@query("x09_julian_epoch", v.with_views("site") + "SELECT sta, epoch(make_date(ondate // 1000, 1, 1) + INTERVAL (ondate % 1000 - 1) DAY) AS t_on, CASE WHEN offdate > 0 THEN epoch(make_date(2024, 1, 20)) END AS t_off FROM site")
def x09(spark, sf):
    return v.site(spark, sf).select("sta", names.julian_to_epoch("ondate").alias("t_on"), names.julian_to_epoch("offdate").alias("t_off"))


_BAND = "'freq_' || (event_id % 4 + 1) || '.0_' || (event_id % 4 + 3) || '.0;env;smooth_' || (event_id % 5 * 3 + 5)"


def _filters(spark, sf):
    e = F.col("event_id")
    return v.table(spark, sf, "events").select("event_id", F.concat(F.lit("freq_"), e % 4 + 1, F.lit(".0_"), e % 4 + 3, F.lit(".0;env;smooth_"), e % 5 * 3 + 5).alias("f"))


@query("x10_band_hz", "SELECT event_id, (event_id % 4 + 1)::DOUBLE AS lo, (event_id % 4 + 3)::DOUBLE AS hi, (event_id % 4 + 2)::DOUBLE AS hz FROM events")
def x10(spark, sf):
    return _filters(spark, sf).select("event_id", names.band_low("f").alias("lo"), names.band_high("f").alias("hi"), names.band_hz("f").alias("hz"))


@query("x11_filter_parse", f"SELECT event_id, regexp_extract({_BAND}, '(freq_[0-9.]+_[0-9.]+)', 1) AS band, (event_id % 5 * 3 + 5)::INTEGER AS smooth FROM events")
def x11(spark, sf):
    return _filters(spark, sf).select("event_id", names.filter_band("f").alias("band"), names.filter_smoothing("f").alias("smooth"))


@query("x12_channel", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'BHZ' ELSE 'BHN' END AS chan FROM events")
def x12(spark, sf):
    chan = F.element_at(F.array(F.lit("SHZ"), F.lit("BHZ"), F.lit("BHN")), (F.col("event_id") % 3 + 1).cast("int"))
    return v.table(spark, sf, "events").select("event_id", names.canonical_channel(chan).alias("chan"))


_PH = "CASE orid % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'Lg' ELSE 'X' END"


def _phased(spark, sf):
    return _points(spark, sf).withColumn("ph", F.when(F.col("orid") % 3 == 0, "P").when(F.col("orid") % 3 == 1, "Lg").otherwise("X"))


_EQ = """, q AS (SELECT *, 1.5 * (1.48 * mb - 2.42) + 9.1 AS lm, CASE WHEN orid % 3 = 1 THEN 0.60 ELSE 0.44 END AS r, CASE WHEN orid % 3 = 1 THEN 103111374869011.25 ELSE 533901911953403.5 END AS sq,
  CASE WHEN orid % 3 = 1 THEN 0.49 * 3526.0 ELSE 0.41 * 6100.0 END AS kv FROM p),
  r AS (SELECT orid, lm + log10(r / (4 * pi() * sq)) - log10(1 + pow(2.5 / (kv * pow(1000000.0 / pow(10.0, lm), 1.0/3.0)), 2.0)) AS a FROM q) """


@query("x13_earthquake_logamp", _PTS + _EQ + "SELECT orid, round(a, 6) AS a FROM r")
def x13(spark, sf):
    return _phased(spark, sf).select("orid", F.round(source.earthquake_logamp("mb", 2.5, "ph"), 6).alias("a"))


@query("x14_explosion_logamp", _PTS + """, q AS (SELECT orid, 2*pi()*2.5 AS w, pow(10.0, (mb - 4.45) / 0.75) AS kt, orid % 3 AS k FROM p), r AS (SELECT *, 122 * pow(kt, 1.0/3) AS h FROM q),
  s AS (SELECT *, 162325 * pow(kt, 1.0/3) * pow(2550.0 * 9.81 * h, -0.417) AS re, 3500.0 * pow(kt, 0.29) * pow(h, -0.11) AS rc, 2550.0 * 9.81 * h AS pr FROM r),
  t AS (SELECT *, 10914.0 / re AS w1, CASE WHEN k = 0 THEN 5500.0 ELSE 3175.0 END / re AS w0, (4.0 * 6780.0 / 3.0) * pow(rc / re, 3.0) AS p0, 1.5 * pr AS pp, pow(5500.0 / (2 * 3175.0), 2.0) AS g FROM s)
  SELECT orid, round(log10(g * pp * re * sqrt(w*w + pow(w1 * p0 / pp, 2.0))) - log10(2550.0 * 5500.0 * sqrt(w*w + w1*w1) * sqrt(pow(w0*w0 - g*w*w, 2.0) + w0*w0*w*w)), 6) AS a FROM t""")
def x14(spark, sf):
    return _phased(spark, sf).select("orid", F.round(source.explosion_logamp("mb", 2.5, "ph"), 6).alias("a"))


@query("x15_amp_transfer", _PTS + _EQ + "SELECT orid, round(1.25 - a, 6) AS t FROM r")
def x15(spark, sf):
    return _phased(spark, sf).select("orid", F.round(source.amp_transfer(1.25, "mb", 2.5, "ph"), 6).alias("t"))


@query("x20_travel_residual", v.with_views("arrival") + "SELECT arid, round(time - (1704067200.0 + slow * 10), 3) AS residual FROM arrival")
def x20(spark, sf):
    return v.arrival(spark, sf).select("arid", F.round(F.col("time") - (1704067200.0 + F.col("slow") * 10), 3).alias("residual"))


@query("x21_azimuth_slowness_correction", v.with_views("arrival") + """, c AS (SELECT *, CASE WHEN slow < 20 THEN 5.0 WHEN slow < 30 THEN -7.0 END AS ca, CASE WHEN slow < 20 THEN 0.5 WHEN slow < 30 THEN -0.25 END AS cs FROM arrival),
  m AS (SELECT *, azimuth - coalesce(ca, 0) AS az FROM c) SELECT arid, CASE WHEN azimuth >= 0 AND slow > 0 THEN CASE WHEN az < 0 THEN az + 360 WHEN az > 360 THEN az - 360 ELSE az END ELSE azimuth END AS azimuth, CASE WHEN azimuth >= 0 AND slow > 0 THEN slow - coalesce(cs, 0) ELSE slow END AS slow FROM m""")
def x21(spark, sf):
    from tremorlake.operators.joins import bin_lookup

    bins = spark.createDataFrame([(0, 0.0, 20.0, 5.0, 0.5), (1, 20.0, 30.0, -7.0, -0.25)], "bin int, low double, high double, ca double, cs double")
    found = bin_lookup(v.arrival(spark, sf), bins, "slow", "arid")
    az, slow = source.correct_azimuth_slowness("azimuth", "slow", "ca", "cs")
    return found.select("arid", az.alias("azimuth"), slow.alias("slow"))


@query("x22_phase_existence", _PTS + f", q AS (SELECT orid, {_D} * 50 AS d, depth AS z, ln(99.0) AS k FROM p) SELECT orid, round(CASE WHEN d < 2000 THEN -ln(1+exp(-k/40.0*(d-140.0))) - ln(1+exp(-k/5.0*(295.0-z))) ELSE -ln(1+exp(-k/60.0*(4940.0-d))) - ln(1+exp(-k/5.0*(695.0-z))) END, 6) AS lp FROM q WHERE abs(z - 295) < 40 AND d < 6000")
def x22(spark, sf):
    p = _points(spark, sf).withColumn("d", geo.dist_deg(*PT) * 50).where("abs(depth - 295) < 40 AND d < 6000")
    return p.select("orid", F.round(source.phase_exists_logp("d", "depth", (100.0, 5000.0, 0.0, 300.0), split=(2000.0, 0.0, 700.0)), 6).alias("lp"))


@query("x23_densities", "SELECT event_id, round(-0.5*pow((value-50)/20,2) - ln(20) - 0.5*ln(2*pi()), 6) AS gaussian, round(-abs(value-50)/5 - ln(10), 6) AS laplace, round(ln(0.02) - 0.02*value, 6) AS exponential, round(-0.5*pow((ln(value)-3)/0.8,2) - ln(0.8*value) - 0.5*ln(2*pi()), 6) AS lognormal, round(2*ln(0.05) - lgamma(2.0) + ln(value) - 0.05*value, 6) AS gamma, round(2*ln(30.0) - lgamma(2.0) - 3*ln(value) - 30.0/value, 6) AS inverse_gamma, round(CASE WHEN value < 50 THEN 0.5*exp((value-50)/5) ELSE 1 - 0.5*exp(-(value-50)/5) END, 6) AS laplace_cdf FROM events WHERE value > 0")
def x23(spark, sf):
    x = "value"
    return v.table(spark, sf, "events").where("value > 0").select("event_id", *(F.round(c, 6).alias(n) for n, c in {"gaussian": dist.gaussian_logp(x, 50, 20), "laplace": dist.laplace_logp(x, 50, 5), "exponential": dist.exponential_logp(x, 0.02), "lognormal": dist.lognormal_logp(x, 3, 0.8), "gamma": dist.gamma_logp(x, 2.0, 0.05), "inverse_gamma": dist.inverse_gamma_logp(x, 2.0, 30.0), "laplace_cdf": dist.laplace_cdf(x, 50, 5)}.items()))


@query("x24_conditional_gaussian", "SELECT event_id, round(-0.5*pow((value - CASE WHEN event_type = 'error' THEN 60 ELSE 40 END)/15.0,2) - ln(15.0) - 0.5*ln(2*pi()), 6) AS lp FROM events")
def x24(spark, sf):
    mean = F.when(F.col("event_type") == "error", 60.0).otherwise(40.0)
    return v.table(spark, sf, "events").select("event_id", F.round(dist.gaussian_logp("value", mean, 15), 6).alias("lp"))


@query("x25_count_logp", "SELECT user_id AS sta, round(count(*) * ln(0.0001) - 0.0001 * 2592000, 6) AS lp FROM events GROUP BY user_id")
def x25(spark, sf):
    n = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("sta")).agg(F.count("*").cast("double").alias("n"))
    return n.select("sta", F.round(source.count_logp("n", 0.0001, 2592000.0), 6).alias("lp"))


@query("x27_detection_probability", v.with_views("origin") + ", z AS (SELECT orid, 0.8*mb - 0.01*exp(mb)/10 - 0.002*depth + 0.05*sqrt(depth) - 1.5 AS s FROM origin) SELECT orid, round(least(0.99999999, greatest(0.00000001, 1/(1+exp(-s)))), 6) AS p FROM z")
def x27(spark, sf):
    s = 0.8 * F.col("mb") - 0.01 * F.exp("mb") / 10 - 0.002 * F.col("depth") + 0.05 * F.sqrt("depth") - 1.5
    return v.origin(spark, sf).select("orid", F.round(geo.clamp(1 / (1 + F.exp(-s)), 1e-8, 1 - 1e-8), 6).alias("p"))


@query("x28_sample_index", v.with_views("arrival") + "SELECT arid, floor((time - 1704067200.0) * 0.5 + 0.0001)::BIGINT AS idx FROM arrival")
def x28(spark, sf):
    return v.arrival(spark, sf).select("arid", source.sample_index("time", 1704067200.0, 0.5).cast("bigint").alias("idx"))


@query("x29_safe_log", "SELECT event_id, round(CASE WHEN value > 50 THEN ln(value - 50) ELSE -99 END, 6) AS l FROM events")
def x29(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.round(source.safe_log(F.col("value") - 50, -99.0), 6).alias("l"))


@query("x30_node_keys", "SELECT event_id, event_id || ';' || user_id || ';' || event_type AS k, event_type AS ph FROM events")
def x30(spark, sf):
    key = names.node_key(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return v.table(spark, sf, "events").select("event_id", key.alias("k"), names.node_part(key, 3).alias("ph"))


@query("x31_date_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, floor(epoch(ts))::BIGINT AS u FROM events")
def x31(spark, sf):
    t = F.col("ts").cast("timestamp")
    return v.table(spark, sf, "events").select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("d"), F.unix_timestamp(t).alias("u"))


@query("x32_string_functions", "SELECT event_id, concat(substr(event_type, 1, 3), '-', ascii(event_type)) AS s, round(abs(value - 50), 2) AS a FROM events")
def x32(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.concat(F.substring("event_type", 1, 3), F.lit("-"), F.ascii("event_type")).alias("s"), F.round(F.abs(F.col("value") - 50), 2).alias("a"))
