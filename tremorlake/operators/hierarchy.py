"""Means of stations pooled over a tree of regions, with all variances learned by expectation and maximisation.

A value is normal about its station's mean, that about its region's, and that about the global one. Stations send what their values say (count, mean, squares: one row each, made once) up
the tree and get back what the others say; expected squares at each level then give new variances. A round is one grouping by region and one over regions;
four numbers of it come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: No variance becomes less than this share of that of all values.
LEAST_SHARE = 1e-6


def _round(stations: DataFrame, v: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Posterior of stations (with their regions') and sums of expected squares, given variances of values, stations and regions."""
    value, station, region = (F.lit(v[k]) for k in ("value", "station", "region"))
    up = F.col("n") / (value + F.col("n") * station)  # precision of a station's mean about its region's
    regions = stations.groupBy("region").agg(F.sum(up).alias("_p"), (F.sum(up * F.col("mean")) / F.sum(up)).alias("_m"))
    r_up = F.col("_p") / (1 + F.col("_p") * region)
    top = regions.agg(F.sum(r_up).alias("_g_p"), (F.sum(r_up * F.col("_m")) / F.sum(r_up)).alias("global_mean"))
    r_all = F.col("_p") + 1 / region
    share = 1 / region / r_all  # how far a region's mean follows the global one
    regions = regions.join(F.broadcast(top), how="cross").select("region", "global_mean", ((F.col("_m") * F.col("_p") + F.col("global_mean") / region) / r_all).alias("region_mean"), (1 / r_all + share * share / F.col("_g_p")).alias("region_var"), share.alias("_share"), "_g_p")  # a single row
    regions = regions.withColumn("_square", F.pow(F.col("region_mean") - F.col("global_mean"), 2) + F.col("region_var") + (1 - 2 * F.col("_share")) / F.col("_g_p"))
    s_all = F.col("n") / value + 1 / station
    s_share = 1 / station / s_all
    post = stations.join(regions, "region").select("region", "sta", "n", "mean", "squares", "global_mean", "region_mean", "region_var", ((F.col("n") * F.col("mean") / value + F.col("region_mean") / station) / s_all).alias("pooled"), (1 / s_all + s_share * s_share * F.col("region_var")).alias("pooled_var"), s_share.alias("_share"))
    sums = post.agg(
        (F.sum(F.col("squares") + F.col("n") * (F.pow(F.col("mean") - F.col("pooled"), 2) + F.col("pooled_var"))) / F.sum("n")).alias("value"),
        F.avg(F.pow(F.col("pooled") - F.col("region_mean"), 2) + F.col("pooled_var") + (1 - 2 * F.col("_share")) * F.col("region_var")).alias("station"),
    ).join(regions.agg(F.avg("_square").alias("region")), how="cross")  # single rows
    return post.drop("_share"), sums


def pooled_tree(rows: DataFrame, region: str, sta: str, x: str, tolerance: float = 1e-4, most_rounds: int = 500, rounds: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(region, sta, n, mean, pooled, pooled_var, region_mean, region_var, global_mean) of each station, and the variances. Rounds go on until no variance moves by more than the
    tolerance of itself, or as many as asked for. Values that are null count for nothing."""
    stats = rows.where(F.col(x).isNotNull()).groupBy(F.col(region).alias("region"), F.col(sta).alias("sta")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("squares"))
    stations = checkpointed(stats)
    whole = stations.agg((F.sum("squares") / F.sum("n")).alias("value"), F.coalesce(F.var_pop("mean"), F.lit(0.0)).alias("station"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("squares") + F.col("n") * F.col("mean") * F.col("mean")).alias("q")).first()
    if not whole.n:
        return stations.select("region", "sta", "n", "mean", *(F.lit(None).cast("double").alias(c) for c in ("pooled", "pooled_var", "region_mean", "region_var", "global_mean"))), {}
    least = max(1e-300, LEAST_SHARE * (whole.q / whole.n - (whole.s / whole.n) ** 2))
    v = {"value": max(least, whole.value), "station": max(least, whole.station / 2), "region": max(least, whole.station / 2)}
    for k in range(rounds if rounds is not None else most_rounds):
        found = _round(stations, v)[1].first()
        new = {c: max(least, found[c]) for c in v}
        moved = max(abs(new[c] / v[c] - 1) for c in v)
        v = new
        if rounds is None and moved <= tolerance:
            break
    return _round(stations, v)[0].select("region", "sta", "n", "mean", "pooled", "pooled_var", "region_mean", "region_var", "global_mean"), v
