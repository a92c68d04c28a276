"""Detection and noise over many waveforms: arrivals of spans, doublets, recent noise, synthetic signals, array stacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join, overlap_join
from .series import best_correlation


def with_arrivals(spans: DataFrame, arrivals: DataFrame, bucket: float) -> DataFrame:
    """Adds to each span (sta, stime, etime) of a waveform the list of its station's arrivals (arid, time) in [stime, etime), in order of time."""
    points = arrivals.select("sta", F.col("time").alias("_a"), F.col("time").alias("_b"), F.struct("time", "arid").alias("_arrival"))
    inside = overlap_join(spans, points, ("stime", "etime"), ("_a", "_b"), bucket, F.col("_a") < F.col("etime"), keys=["sta"])
    lists = inside.groupBy("sta", "stime", "etime").agg(F.array_sort(F.collect_list("_arrival")).alias("arrivals"))
    return spans.join(lists, ["sta", "stime", "etime"], "left").withColumn("arrivals", F.coalesce("arrivals", F.array().cast(lists.schema["arrivals"].dataType)))


def doublets(events: DataFrame, keys: list[str], apart: float, most: int) -> DataFrame:
    """(evid, other, xc, shift): best correlation of each event's window (evid, atime, samples) with that of the next event of its keys, unless they
    arrive less than ``apart`` seconds after each other."""
    w = Window.partitionBy(*keys).orderBy("atime", "evid")
    nxt = events.withColumns({"other_evid": F.lead("evid").over(w), "_t": F.lead("atime").over(w)}).where(F.col("_t") - F.col("atime") >= apart).drop("_t")
    both = nxt.join(events.select(F.col("evid").alias("other_evid"), F.col("samples").alias("other")), "other_evid")
    return best_correlation(both.select("evid", "other_evid", "samples", "other"), most).select("evid", F.col("other_evid").alias("other"), "xc", "shift")


def recent_noise(requests: DataFrame, samples: DataFrame, seconds: float) -> DataFrame:
    """Adds stime, loc and scale to requests (sta, time): mean and deviation over the latest block of so many seconds of the station's samples (sta, time,
    amp, unsafe) that ends by the request's time and has no unsafe one; nulls where there is none."""
    block = F.floor(F.col("time") / seconds).alias("_block")
    fits = samples.groupBy("sta", block).agg(F.avg("amp").alias("loc"), F.stddev_pop("amp").alias("scale"), F.bool_or("unsafe").alias("bad")).where("NOT bad")
    models = fits.select("sta", ((F.col("_block") + 1) * seconds).alias("_end"), F.struct((F.col("_block") * seconds).alias("stime"), "loc", "scale").alias("_model"))
    got = asof_join(requests, models, "sta", "time", "_end", "_model")
    return got.select(*requests.columns, "_model.stime", "_model.loc", "_model.scale")


def fourier_signal(amps: str, phases: str, n: int, srate: float) -> Column:
    """n samples of a sum of cosines of the multiples of the fundamental frequency srate / n, with amplitudes and phases in turns."""
    def at(i):
        term = lambda pair, k: pair.a * F.cos(2 * math.pi * (i / srate * (k + 1) * (srate / n) + pair.p))
        pairs = F.zip_with(amps, phases, lambda a, p: F.struct(a.alias("a"), p.alias("p")))
        return F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda s, t: s + t)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def convolved(x: str, kernel: list[float]) -> Column:
    """x convolved with a short kernel of odd length, over x's span, zeros beyond its ends."""
    half = len(kernel) // 2

    def at(v, i):
        terms = [F.coalesce(F.get(x, i - d), F.lit(0.0)) * c for d, c in zip(range(-half, half + 1), kernel)]
        return sum(terms[1:], terms[0])

    return F.transform(x, at)


def slowness_scan(elements: DataFrame, keys: list[str], offset: str, slownesses: list[int]) -> DataFrame:
    """(keys, slowness, power): power of the stack of an array's elements for each slowness in samples for a unit of offset, over the span of the samples.
    Stacks are partial in each task; a row of the shuffle is a sample of a stack."""
    each = elements.select(*keys, offset, F.explode(F.array(*(F.lit(s) for s in slownesses))).alias("slowness"), "samples")
    at = each.select(*keys, "slowness", offset, F.size("samples").alias("_n"), F.posexplode("samples").alias("_i", "_x")).withColumn("_at", F.col("_i") - F.col("slowness") * F.col(offset))
    stack = at.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).groupBy(*keys, "slowness", "_at").agg(F.sum("_x").alias("_y"))
    return stack.groupBy(*keys, "slowness").agg(F.sum(F.col("_y") * F.col("_y")).alias("power"))
