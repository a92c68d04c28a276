"""Bandwidths of kernel densities by leave-one-out or hold-out likelihood, all of them in one pass.

Points are gathered by place (equal ones once, with their number) and places by cells. Cells near one another meet place by place; others are told the number, the middle
and the radius of a cell only, so that what they add lies between bounds. Far sums are made between cells, whose number depends on their size and not on the data,
near ones by equi-joins on cells. The result has the likelihood with its bounds; bounds narrow as cells get smaller.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo

from .lineage import checkpointed
from .sphere import cell_of

#: Cells that may be sent to all tasks; a sphere has about 41 253 / height**2, a line as many as are asked for.
MOST_CELLS = 200_000
#: What a density is at least, so that its logarithm exists.
LEAST_DENSITY = 1e-300


class Sphere:
    """Points (lon, lat), a kernel that falls by exp(-distance / bandwidth), both in degrees, per square degree of the sphere."""

    columns = ("lon", "lat")

    def __init__(self, height: float):
        if 41_253 / height**2 > MOST_CELLS:
            raise ValueError("cells are too small")
        self.height = height

    def cell(self, df: DataFrame) -> F.Column:
        c = cell_of(F.col("lon"), F.col("lat"), self.height)
        return F.shiftleft(c.getField("ring"), 32) + c.getField("cell")

    def middle(self) -> list[F.Column]:
        lon, lat, w = F.radians("lon"), F.radians("lat"), F.col("m")
        x, y, z = F.sum(w * F.cos(lat) * F.cos(lon)), F.sum(w * F.cos(lat) * F.sin(lon)), F.sum(w * F.sin(lat))
        return [F.degrees(F.atan2(y, x)).alias("c_lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("c_lat")]

    def distance(self, a: tuple, b: tuple) -> F.Column:
        return geo.dist_deg(*a, *b)

    def distances(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        a, b = np.radians(one), np.radians(many)
        h = np.sin((a[1] - b[:, 1]) / 2) ** 2 + np.cos(a[1]) * np.cos(b[:, 1]) * np.sin((a[0] - b[:, 0]) / 2) ** 2
        return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))

    kernel_sql = staticmethod(lambda d, b: F.exp(-d / b))
    kernel = staticmethod(lambda d, b: np.exp(-d / b))

    @staticmethod
    def log_norm(b: float) -> float:
        r = math.radians(b)
        return math.log(2 * math.pi * (1 + math.exp(-math.pi / r)) * r * r / (1 + r * r) * math.degrees(1) ** 2)


class Line:
    """Values x and a normal kernel; cells are bins of a width."""

    columns = ("x",)

    def __init__(self, width: float):
        self.height = width

    def cell(self, df: DataFrame) -> F.Column:
        return F.floor(F.col("x") / self.height).cast("long")

    def middle(self) -> list[F.Column]:
        return [(F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("c_x")]

    def distance(self, a: tuple, b: tuple) -> F.Column:
        return F.abs(F.col(a[0]) - F.col(b[0]))

    def distances(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.abs(many[:, 0] - one[0])

    kernel_sql = staticmethod(lambda d, b: F.exp(-(d / b) * (d / b) / 2))
    kernel = staticmethod(lambda d, b: np.exp(-((d / b) ** 2) / 2))

    @staticmethod
    def log_norm(b: float) -> float:
        return math.log(b * math.sqrt(2 * math.pi))


def _places(points: DataFrame, space) -> DataFrame:
    kept = points.dropna(subset=list(space.columns)).select(*(F.col(c).cast("double").alias(c) for c in space.columns))
    return kept.groupBy(*space.columns).agg(F.count("*").alias("m")).withColumn("cell", space.cell(kept))


def likelihoods(space, data: DataFrame, bandwidths: list[float], tests: DataFrame | None = None, near: float | None = None) -> DataFrame:
    """(bandwidth, n, loglik, low, high): the mean log-density of tests under the kernel density of data, or of every point of data under that of all others. Points with a null are
    left out; nothing to test gives no rows, neither does a single point by itself. Cells less than ``near`` apart (a cell's height if it isn't given) meet place by place."""
    near = space.height if near is None else near
    names = space.columns
    places = checkpointed(_places(data, space))
    asked = checkpointed(_places(tests, space)) if tests is not None else places
    n_data, n_asked = (int(p.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]) for p in (places, asked))
    others = n_data - (tests is None)
    spark = data.sparkSession
    if not n_asked or others < 1:
        return spark.createDataFrame([], "bandwidth double, n long, loglik double, low double, high double")

    def cells_of(p):
        middle = p.groupBy("cell").agg(F.sum("m").alias("n"), *space.middle())
        if middle.count() > MOST_CELLS:
            raise ValueError("cells are too small for this range")
        at = tuple(f"c_{c}" for c in names)
        return p.join(F.broadcast(middle), "cell").groupBy("cell", "n", *at).agg(F.max(space.distance(names, at)).alias("radius"))  # MOST_CELLS rows at most

    held = cells_of(places).toPandas()
    shared = spark.sparkContext.broadcast((held["cell"].to_numpy(), held["n"].to_numpy(float), held[[f"c_{c}" for c in names]].to_numpy(float), held["radius"].to_numpy(float)))
    sums = [f"{kind}{k}" for kind in ("far", "low", "high") for k in range(len(bandwidths))]

    def far(batches):
        cell, n, middle, radius = shared.value
        for batch in batches:
            rows, nears = [], []
            columns = [np.asarray(c) for c in batch.columns]
            for i in range(batch.num_rows):
                d = space.distances(np.array([c[i] for c in columns[2:-1]]), middle)
                slack = radius + columns[-1][i]
                close = d - slack <= near
                d, slack, w = d[~close], slack[~close], n[~close]
                rows.append([float(w @ space.kernel(x, b)) for x in (d, d + slack, np.maximum(d - slack, 0)) for b in bandwidths])
                nears.append(cell[close].tolist())
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(len(sums))), pa.array(nears, pa.list_(pa.int64()))], ["cell", *sums, "near"])

    far_sums = checkpointed(cells_of(asked).repartition("cell").mapInArrow(far, "cell long, " + ", ".join(f"{s} double" for s in sums) + ", near array<long>"))
    pairs = asked.join(far_sums.select("cell", F.explode("near").alias("o_cell")), "cell").join(places.select(F.col("cell").alias("o_cell"), F.col("m").alias("o_m"), *(F.col(c).alias(f"o_{c}") for c in names)), "o_cell")
    d = space.distance(names, tuple(f"o_{c}" for c in names))
    met = pairs.withColumn("d", d).groupBy(*names, "cell", "m").agg(*(F.sum(F.col("o_m") * space.kernel_sql(F.col("d"), b)).alias(f"near{k}") for k, b in enumerate(bandwidths)))
    # a place without any near data has no row there; a point is no other of itself
    full = asked.join(met, [*names, "cell", "m"], "left").join(far_sums.drop("near"), "cell")
    own = 1.0 if tests is None else 0.0
    out = []
    for k, b in enumerate(bandwidths):
        log = lambda kind: F.log(F.greatest((F.greatest(F.coalesce(F.col(f"near{k}"), F.lit(0.0)) - own, F.lit(0.0)) + F.col(f"{kind}{k}")) * (1 / others), F.lit(LEAST_DENSITY))) - space.log_norm(b)  # noqa: B023, E731
        out.append(F.struct(F.lit(float(b)).alias("bandwidth"), *((F.sum(F.col("m") * log(kind)) / n_asked).alias(name) for kind, name in (("far", "loglik"), ("low", "low"), ("high", "high")))))
    return full.agg(F.array(*out).alias("b")).select(F.explode("b").alias("b")).select("b.bandwidth", F.lit(n_asked).cast("long").alias("n"), "b.loglik", "b.low", "b.high")


def best_bandwidth(space, data: DataFrame, bandwidths: list[float], tests: DataFrame | None = None, near: float | None = None) -> float:
    """The bandwidth of the greatest likelihood; of equals the least."""
    rows = likelihoods(space, data, bandwidths, tests, near).collect()  # a row for each bandwidth
    return max(rows, key=lambda r: (r.loglik, -r.bandwidth)).bandwidth
