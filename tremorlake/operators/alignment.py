"""Arrival times of similar events aligned by the shifts between their waveforms.

Events near one another should look alike at a station. Each pair says by how much one is late against the other; corrections of arrival times are the least squares over
all pairs, which a prior draws towards zero. The normal equations are sparse and as large as the catalogue, so they are solved by conjugate gradients whose vectors are tables:
a round is one join of the pairs with the direction and one grouping by node, and only three sums of a round come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo

from .lineage import checkpointed
from .series import best_correlation
from .sphere import near_join


def pair_shifts(windows: DataFrame, km: float = 15.0, most: int = 5, least_xc: float = 0.0) -> DataFrame:
    """(a, b, d, w): of windows (node, sta, lon, lat, srate, samples) at one station and of events within km, how many seconds b's waveform is late against a's, from
    the best correlation over shifts of at most ``most`` samples, and that correlation as a weight."""
    a = windows.select("node", "sta", "lon", "lat", "srate", "samples")
    b = windows.select("sta", *(F.col(c).alias(f"o_{c}") for c in ("node", "lon", "lat", "samples")))
    degrees = math.degrees(km / geo.EARTH_RADIUS_KM)
    pairs = near_join(a, b, degrees, F.col("node") < F.col("o_node"), keys=["sta"]).select("node", "o_node", "srate", "samples", F.col("o_samples").alias("other"))
    found = best_correlation(pairs, most).where(F.col("xc") > least_xc)
    return found.select(F.col("node").alias("a"), F.col("o_node").alias("b"), (-F.col("shift") / F.col("srate")).alias("d"), F.col("xc").alias("w"))


def least_squares(pairs: DataFrame, ridge: float | Column = 0.0, tolerance: float = 1e-10, most_rounds: int = 1000) -> DataFrame:
    """(node, x): the minimum of the sum of w (x_b - x_a - d)^2 over pairs (a, b, d, w) plus ridge times that of x^2. A ridge may be a column over
    deg, the weights of a node's pairs, so that a node with few pairs is drawn towards zero in place of those it lacks. Without a ridge the x of each connected part
    sum to zero. Rounds end when the residual is less than the tolerance times the first one; not getting there is an error."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "w", (-F.col("d")).alias("d")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "w", "d"))
    links = checkpointed(both.groupBy("node", "other").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("wd")))
    start = links.groupBy("node").agg(F.sum("w").alias("deg"), F.sum("wd").alias("r"))

    def applied(state: DataFrame) -> DataFrame:
        """state with q, the matrix times p."""
        far = links.join(state.select(F.col("node").alias("other"), F.col("p").alias("o_p")), "other").groupBy("node").agg(F.sum(F.col("w") * F.col("o_p")).alias("_s"))
        return state.join(far, "node").withColumn("q", (F.col("deg") + ridge) * F.col("p") - F.col("_s")).drop("_s")

    dots = lambda s: s.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("r") * F.col("q")).alias("rq"), F.sum(F.col("q") * F.col("q")).alias("qq")).first()
    state = checkpointed(applied(start.select("node", "deg", F.lit(0.0).alias("x"), "r", F.col("r").alias("p"))))
    first = None
    for _ in range(most_rounds):
        s = dots(state)
        first = s.rr if first is None else first
        if not s.rr or s.rr <= tolerance**2 * first or s.pq <= 0:
            return state.select("node", "x")
        alpha = s.rr / s.pq
        beta = max(0.0, s.rr - 2 * alpha * s.rq + alpha * alpha * s.qq) / s.rr
        r = F.col("r") - alpha * F.col("q")
        state = checkpointed(applied(state.select("node", "deg", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r + beta * F.col("p")).alias("p"))))
    raise ValueError("no convergence")


def aligned(windows: DataFrame, arrivals: DataFrame, km: float = 15.0, most: int = 5, least_xc: float = 0.0, prior_seconds: float = 3.0, pick_seconds: float = 1.0) -> DataFrame:
    """(node, atime): arrivals (node, atime) moved by the corrections of their windows. A travel time's residual is as sure as prior_seconds, a shift of
    correlation 1 as pick_seconds; arrivals without similar ones stay."""
    moved = least_squares(pair_shifts(windows, km, most, least_xc), (pick_seconds / prior_seconds) ** 2)
    return arrivals.join(moved, "node", "left").select("node", (F.col("atime") + F.coalesce("x", F.lit(0.0))).alias("atime"))
