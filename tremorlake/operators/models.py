"""Grouped fits and grid scoring of events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import dist, geo

from . import votes
from .ranks import medians


def linear_fits(rows: DataFrame, keys: list[str], features: dict[str, Column], y: str, prior: float = 1e-3) -> DataFrame:
    """Bayesian linear regression per group: moments are summed by Spark (k * k sums a group, partial in each task), a
    small system is solved for each group. Adds the coefficients as an array in the order of the features."""
    names = list(features)
    x = rows.select(*keys, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(features.values())), F.col(y).cast("double").alias("_y"))
    k = len(names)
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_b{i}") for i in range(k)]
    moments = x.groupBy(*keys).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"_s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + prior * np.eye(k)
                out.append(np.linalg.solve(a, np.array([r[f"_b{i}"] for i in range(k)])).tolist())
            yield pdf[[*keys, "n"]].assign(coefficients=out)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in (*keys, "n"))
    return moments.mapInPandas(solve, f"{base}, coefficients array<double>")


def robust_line(rows: DataFrame, keys: list[str], x: str, y: str, rounds: int = 3, bound: float = 3.0) -> DataFrame:
    """Slope and intercept per group; each round leaves out points further than bound deviations from the last line."""
    kept = rows
    for _ in range(rounds):
        fit = kept.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
        resid = rows.join(fit, keys).withColumn("_r", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
        spread = resid.groupBy(*keys).agg(F.stddev_pop("_r").alias("_d"))
        kept = resid.join(spread, keys).where(F.abs(F.col("_r")) <= bound * F.col("_d")).select(*rows.columns)
    return fit


def gaussian_process(rows: DataFrame, keys: list[str], at: list[float], x: str, y: str, length: float, noise: float, most: int = 2000) -> DataFrame:
    """(keys, x, mean, var): posterior of a Gaussian process with a squared-exponential kernel at some points, per group.
    Points of one x are summed by Spark first: their mean with the noise of so many is exactly what they say together. A
    group has any number of points at ``most`` different x; one with more is an error, not a sample."""
    points = rows.groupBy(*keys, F.col(x).alias("_x")).agg(F.avg(y).alias("_y"), F.count(y).alias("_n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most:
            raise ValueError(f"{len(part)} different places in a group of a dense process; at most {most}")
        part = part.sort_values("_x", kind="stable")
        px, py, n, q = part["_x"].to_numpy(float), part["_y"].to_numpy(float), part["_n"].to_numpy(float), np.array(at, float)
        kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None, :]) / length) ** 2)
        low = np.linalg.cholesky(kernel(px, px) + np.diag(noise**2 / n))
        mean0 = (n * py).sum() / n.sum()
        cross = np.linalg.solve(low, kernel(px, q))
        mean = mean0 + cross.T @ np.linalg.solve(low, py - mean0)
        var = 1 + noise**2 - (cross**2).sum(axis=0)
        return pd.DataFrame({**{k: [part[k].iloc[0]] * len(q) for k in keys}, "at": q, "mean": mean, "var": var})

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    return points.groupBy(*keys).applyInPandas(fit, f"{base}, at double, mean double, var double")


def cross_validated(rows: DataFrame, key: str, x: str, y: str, k: int = 5) -> DataFrame:
    """(mean_abs, median_abs) error of a line fitted on the other folds."""
    from .sequences import folds

    parts = folds(rows, key, k).select("fold", x, y)
    fits = parts.withColumn("held", F.explode(F.array(*map(F.lit, range(k))))).where("held <> fold").groupBy("held").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    error = F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    errors = parts.join(F.broadcast(fits.withColumnRenamed("held", "fold")), "fold").select(error.alias("_e"))
    return errors.agg(F.avg("_e").alias("mean_abs")).join(medians(errors, [], "_e", "median_abs"), how="cross")  # single rows


def clusters(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds cluster: k means over (lon, lat, depth / 100)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["lon", "lat", "_z"], outputCol="_v").transform(rows.withColumn("_z", F.col("depth") / 100))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v", "_z")


def detection_model(rows: DataFrame, label: str) -> dict[str, float]:
    """Logistic regression of detection on (mb, e^mb / 100, depth, sqrt depth, distance, ln distance); where nothing was
    detected zero weights and an intercept of -10."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = ["mb", "exp_mb", "depth", "sqrt_depth", "dist", "log_dist"]
    if not rows.where(F.col(label)).limit(1).count():
        return {n: 0.0 for n in names} | {"intercept": -10.0}
    full = rows.withColumns({"exp_mb": F.exp("mb") / 100, "sqrt_depth": F.sqrt("depth"), "log_dist": F.log1p("dist")})
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1e-4).fit(VectorAssembler(inputCols=names, outputCol="_v").transform(full.withColumn("_y", F.col(label).cast("double"))))
    return dict(zip(names, map(float, model.coefficients))) | {"intercept": float(model.intercept)}


def noise_priors(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, n, mean, sd, variance): what the log amplitudes of blocks of so many seconds (of two rows or more) are like per key: the mean and deviation of
    their means, and their mean variance."""
    log = rows.where("amp > 0").groupBy(key, F.floor(F.col("time") / seconds).alias("_block")).agg(F.avg(F.ln("amp")).alias("m"), F.var_pop(F.ln("amp")).alias("s"), F.count("*").alias("k")).where("k > 1")
    return log.groupBy(key).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.avg("s").alias("variance"))


def mixture(rows: DataFrame, x: str, k: int, tries: int = 2) -> DataFrame:
    """(component, weight, mean, var) of a Gaussian mixture over one column: the likeliest of several that begin elsewhere."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=[x], outputCol="_v").transform(rows.where(F.col(x).isNotNull()).select(x))
    model = max((GaussianMixture(k=k, seed=seed, featuresCol="_v").fit(ready) for seed in range(tries)), key=lambda m: m.summary.logLikelihood)
    parts = sorted((float(g.mean[0]), float(g.cov.toArray()[0, 0]), float(w)) for w, g in zip(model.weights, model.gaussians))
    return rows.sparkSession.createDataFrame([(i, w, m, s) for i, (m, s, w) in enumerate(parts)], "component int, weight double, mean double, var double")


def bin_index(x: str | Column, start: float, size: float, n: int) -> Column:
    """Bin of a value, with a small excess against rounding; the last bin is closed on the right."""
    c = F.col(x) if isinstance(x, str) else x
    i = F.floor((c - start) / size + 1e-8)
    return F.when((c >= start) & (c <= start + size * n), F.least(i, F.lit(n - 1)))


def event_grid(templates: DataFrame, stations: DataFrame, lon_step: float, lat_step: float, tick: float, speed_km_s: float = 8.0, scale: float = 5.0, log_rate: float = -8.0) -> DataFrame:
    """(cell, tbin, score, n): score of an event in each cell and time bin that any detection supports.

    templates: (sta, phase, atime); stations: (sta, slon, slat). Each template votes for the origin times that its cells
    imply: the Laplace mass of the bin around its travel time, less the rate of false detections. Per station, phase, cell
    and bin only the best template counts; bins without any stay out, which is what a score of 0 means. Templates are
    shuffled by periods of time, and what they vote for is summed where they are (``votes``).
    """
    n_lon, n_lat, bins = int(360 / lon_step), int(180 / lat_step), votes.bins_in_period(tick, speed_km_s)

    def count(table: pa.Table) -> pa.Table:
        low = table["period"][0].as_py() * bins
        picks = votes.Picks(table, 3 * tick)
        lon = np.arange(n_lon) * lon_step - 180 + lon_step / 2
        out = []
        for line in range(n_lat):
            score, n = votes.scores(picks, lon, np.full(n_lon, line * lat_step - 90 + lat_step / 2), tick, low, np.arange(bins), bins, speed_km_s, scale, log_rate)
            place, k = np.nonzero(n)
            out.append((place + line * n_lon, k + low, score[place, k], n[place, k]))
        cell, tbin, score, n = (np.concatenate(x) for x in zip(*out))
        return pa.table({"cell": cell.astype(np.int32), "tbin": tbin, "score": score, "n": n})

    return votes.dealt(templates, stations, tick, speed_km_s).groupBy("period").applyInArrow(count, "cell int, tbin long, score double, n long")


def grid_peaks(grid: DataFrame, per_bin: int = 1) -> DataFrame:
    """The best cells of each time bin, with their share of the bin's probability."""
    top = grid.groupBy("tbin").agg(F.max("score").alias("_m"))
    weight = F.exp(F.col("score") - F.col("_m"))
    shared = grid.join(top, "tbin").withColumn("_w", weight)
    total = shared.groupBy("tbin").agg(F.sum("_w").alias("_t"))
    ranked = shared.join(total, "tbin").withColumn("_k", F.row_number().over(Window.partitionBy("tbin").orderBy(F.desc("score"), "cell")))
    return ranked.where(F.col("_k") <= per_bin).select("tbin", "cell", "score", "n", (F.col("_w") / F.col("_t")).alias("p"))


#: Picks of events that are located side by side.
_PICKS = 20_000


def located(arrivals: DataFrame, speed_km_s: float = 8.0, rounds: int = 15, starts: int = 4, enough: float = 0.1) -> DataFrame:
    """(evid, lon, lat, t0, rms): least-squares locations from arrival times (evid, slon, slat, atime), by Gauss-Newton
    with small damped steps from each of the ``starts`` stations that saw the event first, until one ends with residuals of ``enough`` seconds; else the best of
    these counts."""

    moves = np.concatenate([np.zeros((1, 3)), np.eye(3) * 1e-3, np.eye(3) * -1e-3])

    def predict(p, sx, sy):
        """Arrival times (event, place, pick) from places and times (event, place, 3)."""
        a, b = np.radians(p[:, :, 1:2]), np.radians(sy)[:, None, :]
        h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(p[:, :, :1] - sx[:, None, :]) / 2) ** 2
        return p[:, :, 2:] + 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) * geo.EARTH_RADIUS_KM / speed_km_s

    def descend(p, sx, sy, t):
        """Events descend side by side; one that stands still is left alone."""
        p, go = p.copy(), np.arange(len(p))
        for _ in range(rounds):
            near = predict(p[go, None, :] + moves, sx[go], sy[go])
            r, jac = t[go] - near[:, 0], (near[:, 1:4] - near[:, 4:]).transpose(0, 2, 1) / 2e-3
            back = jac.transpose(0, 2, 1)
            step = np.linalg.solve(back @ jac + 1e-3 * np.eye(3), back @ r[:, :, None])[:, :, 0]
            step[:, :2] = np.clip(step[:, :2], -10, 10)
            p[go] += step
            p[go, 1] = np.clip(p[go, 1], -89.9, 89.9)
            go = go[np.abs(step).max(axis=1) >= 1e-7]
            if not len(go):
                break
        return ((t - predict(p[:, None, :], sx, sy)[:, 0]) ** 2).mean(axis=1), p

    def fit(t, sx, sy):
        """(lon, lat, t0, mean square) of events of equally many picks, which are in order of time."""
        out, cost, todo = np.zeros((len(t), 3)), np.full(len(t), np.inf), np.arange(len(t))
        for k in range(min(starts, t.shape[1])):
            c, p = descend(np.stack([sx[todo, k], sy[todo, k] + 0.1, t[todo, k]], axis=1), sx[todo], sy[todo], t[todo])
            less = c < cost[todo]
            cost[todo[less]], out[todo[less]] = c[less], p[less]
            todo = todo[~(cost[todo] < enough * enough)]
            if not len(todo):
                break
        return np.column_stack([out, cost])

    def locate(batches):
        for batch in batches:
            picks = batch.column(1)
            flat, sizes = picks.flatten(), picks.value_lengths().to_numpy(zero_copy_only=False)
            t, sx, sy = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            first, found = np.cumsum(sizes) - sizes, np.zeros((len(sizes), 4))
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                few = max(1, _PICKS // int(size))
                for a in range(0, len(same), few):
                    at = first[same[a : a + few], None] + np.arange(size)
                    found[same[a : a + few]] = fit(t[at], sx[at], sy[at])
            yield pa.record_batch([batch.column(0), pa.array((found[:, 0] + 180) % 360 - 180), pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy()), pa.array(np.sqrt(found[:, 3]))], ["evid", "lon", "lat", "t0", "rms"])

    picks = arrivals.groupBy(F.col("evid").cast("long").alias("evid")).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("atime", "slon", "slat"))))).alias("picks"))
    return picks.mapInArrow(locate, "evid long, lon double, lat double, t0 double, rms double")


def nearest_values(rows: DataFrame, queries: DataFrame, x: str, qx: str, y: str, width: float, k: int) -> DataFrame:
    """Mean y of the k nearest rows within a width of each query's place."""
    from .joins import band_join

    near = band_join(queries, rows, qx, x, width)
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.abs(F.col(x) - F.col(qx)), x, y))).where(F.col("_k") <= k)
    return ranked.groupBy("qid").agg(F.avg(y).alias("value"), F.count("*").alias("n"))


def run_blocks(blocks: DataFrame, steps: int = 2000) -> DataFrame:
    """Metropolis-Hastings per block and seed: posterior of a Poisson process's log-rate from (block, seed, n, seconds).
    Blocks and seeds are independent rows; inside a row the chain is sequential."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rng = np.random.default_rng(abs(hash((int(r.block), int(r.seed)))) % 2**32)
                x = math.log((r.n + 1) / r.seconds)
                logp = lambda v: r.n * v - math.exp(v) * r.seconds - 0.5 * (v / 10) ** 2
                now, kept, accepted = logp(x), [], 0
                for k in range(steps):
                    y = x + rng.normal(scale=1.5 / math.sqrt(r.n + 1))
                    new = logp(y)
                    if new - now > math.log(1 - rng.random()):
                        x, now, accepted = y, new, accepted + 1
                    if k >= steps // 4:
                        kept.append(x)
                rows.append((r.block, r.seed, float(np.exp(np.mean(kept))), float(np.std(kept)), accepted / steps))
            yield pd.DataFrame(rows, columns=["block", "seed", "rate", "log_sd", "accepted"])

    return blocks.mapInPandas(run, "block long, seed int, rate double, log_sd double, accepted double")
