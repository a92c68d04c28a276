"""Gaussian processes over any number of places, by overlapping local ones.

The places of a group are cut by rank into runs of equal size. Each run has a dense process of its own over its places and those of the runs beside it, and a point's prediction passes
from one run's to the next as the point moves between their middles: weights fall linearly by rank and add up to one. So a solve has at most three runs of places wherever they crowd, and where one run holds
all places the result is that of the dense process. With a compact support no place further than that has any say.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranks import latest, ranked

#: Points that one task predicts from one run's places.
PREDICTED = 20_000


def covariance(a: np.ndarray, b: np.ndarray, length: float, support: float | None) -> np.ndarray:
    """Squared-exponential, tapered to zero at the support if there is one."""
    d = np.abs(a[:, None] - b[None, :])
    k = np.exp(-0.5 * (d / length) ** 2)
    if support is None:
        return k
    r = np.minimum(d / support, 1)
    return k * (1 - r) ** 4 * (4 * r + 1)


def posterior(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, center: float, length: float, noise: float, support: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a new value at some points, given the means y of n values each at x."""
    low = np.linalg.cholesky(covariance(x, x, length, support) + np.diag(noise**2 / n))
    cross = np.linalg.solve(low, covariance(x, at, length, support))
    return center + cross.T @ np.linalg.solve(low, y - center), 1 + noise**2 - (cross**2).sum(axis=0)


def local_process(rows: DataFrame, points: DataFrame, keys: list[str], x: str, y: str, length: float, noise: float, size: int = 500, support: float | None = None) -> DataFrame:
    """(keys, at, mean, var) at the points (keys, at) of each group that has values. Rows with a null x or y count for nothing. Values at one place are summed first, so a place's
    noise is that of so many. Points beyond all places are predicted from the nearest run."""
    kept = rows.dropna(subset=[*keys, x, y])
    places = kept.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.avg(y).alias("_y"), F.count("*").alias("_n"))
    group = F.struct(*keys)
    placed = checkpointed(ranked(places, keys, ["_x"], "_rank", "_size").withColumn("_g", group))
    about = placed.groupBy("_g").agg(F.first("_size").alias("_size"), (F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("_center"))
    last = F.ceil(F.col("_size") / size) - 1  # the last run
    # a point between two middles asks both runs
    asked = points.select(*keys, F.col("at").cast("double").alias("at")).distinct().withColumn("_g", group)
    found = latest(asked, placed.select("_g", F.col("_x").alias("_t"), F.col("_rank").alias("_below")), "_g", "at", "_t", "_below").join(about, "_g")
    v = F.coalesce("_below", F.lit(0)) / size - 0.5
    both = F.array(F.struct(F.floor(v).alias("run"), (F.floor(v) + 1 - v).alias("w")), F.struct((F.floor(v) + 1).alias("run"), (v - F.floor(v)).alias("w")))
    spread = found.withColumn("_b", F.explode(both)).select("_g", "at", "_center", F.greatest(F.lit(0), F.least("_b.run", last)).cast("long").alias("_run"), F.col("_b.w").alias("_w")).where("_w > 0")
    wanted = checkpointed(spread.groupBy("_g", "at", "_center", "_run").agg(F.sum("_w").alias("_w")))
    parts = wanted.groupBy("_g", "_run").agg(F.ceil(F.count("*") / PREDICTED).cast("long").alias("_parts"))
    home = F.floor((F.col("_rank") - 0.5) / size)
    near = placed.withColumn("_run", F.explode(F.sequence(F.greatest(F.lit(0), home - 1), F.least(home + 1, last)))).select("_g", "_run", "_x", "_y", "_n")
    train = near.join(parts, ["_g", "_run"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    ask = wanted.join(parts, ["_g", "_run"]).withColumn("_part", F.pmod(F.xxhash64("at"), F.col("_parts")))

    def solve(places: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(places) or not len(points):
            return pd.DataFrame({"at": [], "_w": [], "mean": [], "var": [], "_number": []}).astype("float64").astype({"_number": "int64"})
        p = places.sort_values("_x", kind="stable")
        at = points["at"].to_numpy(float)
        mean, var = posterior(*(p[c].to_numpy(float) for c in ("_x", "_y", "_n")), at, float(points["_center"].iloc[0]), length, noise, support)
        return pd.DataFrame({"at": at, "_w": points["_w"].to_numpy(float), "mean": mean, "var": var, "_number": points["_number"].to_numpy()})

    number = F.xxhash64(*[F.col(f"_g.{k}") for k in keys])  # what tells a group in the solver's rows; a group's columns come back by it
    left = train.select(number.alias("_number"), "_run", "_part", "_x", "_y", "_n")
    right = ask.select(number.alias("_number"), "_run", "_part", "at", "_center", "_w")
    done = left.groupBy("_number", "_run", "_part").cogroup(right.groupBy("_number", "_run", "_part")).applyInPandas(solve, "at double, _w double, mean double, var double, _number long")
    blended = done.groupBy("_number", "at").agg((F.sum(F.col("_w") * F.col("mean")) / F.sum("_w")).alias("mean"), (F.sum(F.col("_w") * F.col("var")) / F.sum("_w")).alias("var"))
    return blended.join(about.select(number.alias("_number"), "_g"), "_number").select(*(F.col(f"_g.{k}").alias(k) for k in keys), "at", "mean", "var")
