"""Queries that write waveform archives from the embeddings and fetch from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators.lineage import shared_path
from tremorlake.sources import waveforms as w

from . import views as v
from .registry import query

#: Ten segments of 64 samples a second, 80 seconds apart, at each station; samples in thousandths.
_SEGMENTS = "WITH e AS (SELECT vec_id, vec_id // 10 AS sta, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 1000, 0) / 1000) AS x FROM embeddings) "


def _segments(spark, sf):
    e = v.table(spark, sf, "embeddings")
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000) / 1000)
    chan = F.element_at(F.array(F.lit("BHZ"), F.lit("SHZ")), (F.col("vec_id") % 2 + 1).cast("int"))
    datatype = F.when(F.col("vec_id") % 3 == 0, "s3").otherwise("s4")
    return e.select("vec_id", F.floor(F.col("vec_id") / 10).cast("string").alias("sta"), chan.alias("chan"), (F.col("vec_id") * 80.0).alias("time"), F.lit(1.0).alias("samprate"), datatype.alias("datatype"), F.lit(0.001).alias("calib"), thousandths.alias("samples"))


def _archive(spark, sf):
    path = shared_path(spark, "archive")
    w.write_archive(_segments(spark, sf), path)
    return path


def _weighted(samples="samples"):
    return F.aggregate(F.transform(samples, lambda s, i: F.coalesce(s, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, b: a + b)


@query("s10_binary_samples", _SEGMENTS + "SELECT CAST(sta AS VARCHAR) AS sta, vec_id * 80.0 AS time, len(x) AS n, CAST(round(1000 * list_sum(list_transform(x, lambda s, i: s * i))) AS BIGINT) AS s FROM e")
def s10(spark, sf):
    rows = w.scan(spark, _archive(spark, sf))
    return rows.select("sta", "time", F.size("samples").cast("long").alias("n"), F.round(_weighted() * 1000).cast("long").alias("s"))


@query("s10_sample_chunks", _SEGMENTS + ", c AS (SELECT sta, vec_id * 80.0 + k AS time, x[k + 1:k + 16] AS x FROM e, (SELECT unnest([0, 16, 32, 48]) AS k)) SELECT CAST(sta AS VARCHAR) AS sta, time, len(x) AS n, CAST(round(1000 * list_sum(list_transform(x, lambda s, i: s * i))) AS BIGINT) AS s FROM c WHERE time + 16 > 480 AND time < (SELECT max(vec_id) * 80 FROM e)")
def s10_chunks(spark, sf):
    last = v.table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    rows = w.scan(spark, _archive(spark, sf), after=480.0, before=last * 80.0, chunk=16)
    return rows.select("sta", "time", F.size("samples").cast("long").alias("n"), F.round(_weighted() * 1000).cast("long").alias("s"))


#: Each request runs from 30 seconds into a segment for 100 seconds; with 20 seconds of padding it holds 54 samples of that one, a gap, and all of the next one if there is any.
_FETCH = _SEGMENTS + """, r AS (SELECT a.vec_id AS rid, a.x[11:64] AS x, b.x AS y FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1 AND b.sta = a.sta),
g AS (SELECT rid, y IS NOT NULL AS two, x, y, list_transform(generate_series(0, 139), lambda i: CASE
    WHEN i < 54 THEN x[i + 1]
    WHEN y IS NULL THEN CASE WHEN i < 108 THEN x[54 - (i - 54)] ELSE list_avg(x) END
    WHEN i < 62 THEN x[54 - (i - 54)] WHEN i < 70 THEN y[70 - i] WHEN i < 134 THEN y[i - 69] ELSE y[64 - (i - 134)] END) AS z FROM r)
SELECT rid, rid * 80.0 + 10 AS stime, 1.0 AS srate, CAST(len(z) AS BIGINT) AS n, round(list_sum(list_transform(generate_series(20, 119), lambda i: z[i + 1] * (i + 1))), 3) AS s FROM g"""


@query("s11_fetch_waveform", _FETCH)
def s11(spark, sf):
    requests = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"), F.floor(F.col("vec_id") / 10).alias("sta"), F.lit("BHZ").alias("chan"), (F.col("vec_id") * 80.0 + 30).alias("stime"), (F.col("vec_id") * 80.0 + 130).alias("etime"))
    got = w.fetch(requests, _archive(spark, sf), pad=20.0)
    return got.select("rid", "stime", "srate", F.size("samples").cast("long").alias("n"), F.round(_weighted(), 3).alias("s"))


#: SAC files of 64 samples: every third station's are constant at 20 Hz, others vary at 10 Hz and follow without a gap; every seventh file is named .HR., and of station 1 mod 5 odd ones .10.
_SAC = """WITH e AS (SELECT vec_id, vec_id // 10 AS sta, embedding AS x FROM embeddings),
f AS (SELECT vec_id, sta, CASE WHEN vec_id % 3 = 0 THEN 20.0 ELSE 10.0 END AS hz, vec_id * 6.4 AS t, x, vec_id % 7 = 0 AS hr, vec_id % 10 % 2 = 1 AND sta % 5 = 1 AS ten FROM e) """


def _sac(spark, sf):
    id_ = F.col("vec_id")
    kind = F.when(id_ % 7 == 0, "HR").when((id_ % 10 % 2 == 1) & (F.floor(id_ / 10) % 5 == 1), "10").otherwise("X")
    steady = F.transform("embedding", lambda x: F.element_at("embedding", 1).cast("double"))
    e = v.table(spark, sf, "embeddings").select(
        F.format_string("%d/%d.%s.SAC", F.floor(id_ / 10), id_, kind).alias("dfile"), F.floor(id_ / 10).cast("string").alias("sta"), F.lit("BHZ").alias("chan"), (id_ * 6.4).alias("time"),
        F.when(id_ % 3 == 0, 20.0).otherwise(10.0).alias("samprate"), F.when(id_ % 3 == 0, F.concat(steady, steady)).otherwise(F.col("embedding").cast("array<double>")).alias("samples"),
    )
    path = shared_path(spark, "sac")
    w.write_sac(e, path)
    return path


@query("s14_sac_index", _SAC + "SELECT CAST(sta AS VARCHAR) AS sta, 'BHZ' AS chan, round(t, 3) AS time, round(t + 6.4, 3) AS endtime, hz AS samprate, CASE WHEN hz > 10 THEN 128 ELSE 64 END::BIGINT AS nsamp, vec_id || CASE WHEN hr THEN '.HR.SAC' WHEN ten THEN '.10.SAC' ELSE '.X.SAC' END AS name FROM f")
def s14(spark, sf):
    got = w.sac_index(spark, _sac(spark, sf))
    return got.select("sta", "chan", F.round("time", 3).alias("time"), F.round("endtime", 3).alias("endtime"), "samprate", "nsamp", F.element_at(F.split("dfile", "/"), -1).alias("name"))


#: A request for each station's 64 seconds: files named .HR. are out, those named .10. alone where there are any. Ten samples a second, a constant where a file is decimated.
_SAC_FETCH = _SAC + """, k AS (SELECT *, max(ten AND NOT hr) OVER (PARTITION BY sta) AS tens FROM f),
u AS (SELECT * FROM k WHERE NOT hr AND (ten OR NOT tens)),
p AS (SELECT sta, vec_id % 10 * 64 + i AS pos, CAST(CASE WHEN hz > 10 THEN x[1] ELSE x[i + 1] END AS DOUBLE) AS x FROM u, (SELECT unnest(generate_series(0, 63)) AS i))
SELECT sta AS rid, sta * 64.0 AS stime, CAST(count(*) AS BIGINT) AS n, round(sum(x * (pos + 1)), 2) AS s FROM p GROUP BY sta"""


@query("s12_fetch_sac", _SAC_FETCH)
def s12(spark, sf):
    path = _sac(spark, sf)
    requests = v.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("rid")).agg(F.count("*").alias("n")).select("rid", F.col("rid").alias("sta"), F.lit("BHZ").alias("chan"), (F.col("rid") * 64.0).alias("stime"), (F.col("rid") * 64.0 + 64).alias("etime"))
    got = w.fetch(requests, path, pad=0.0, layout="sac", index=w.sac_index(spark, path), mirror=False)
    return got.select("rid", "stime", F.size(F.filter("samples", lambda x: x.isNotNull())).cast("long").alias("n"), F.round(_weighted(), 2).alias("s"))
