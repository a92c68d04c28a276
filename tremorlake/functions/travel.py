"""Travel-time tables and priors as column expressions and lookups: gradients, slowness, incidence, inversion, location and depth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geo
from .tables import cell_of

#: The mixture of a depth prior, 0.7 exponential of mean 5 km and 0.3 gamma beyond a shift (shift, shape, scale in km).
DEPTH_SURFACE, DEPTH_MEAN = 0.7, 5.0
DEPTH_SHIFT, DEPTH_SHAPE, DEPTH_SCALE = 6.27209, 1.41801048, 126.7144
DEEPEST = 700.0
#: Fixed value: log-density of a valid location outside of the table's region.
OUTSIDE = -40.0


def bilinear_gradient(rows: DataFrame, cells: DataFrame, x: str, y: str, step_x: float, step_y: float, n_x: int, n_y: int) -> DataFrame:
    """Adds d_x and d_y, the slopes of the interpolated surface within a row's cell; null outside the grid or where a corner is missing."""
    placed = rows.withColumns({"i": cell_of(x, step_x, n_x), "j": cell_of(y, step_y, n_y)})
    u, w = F.col(x) / step_x - F.col("i"), F.col(y) / step_y - F.col("j")
    d_x = ((F.col("v10") - F.col("v00")) * (1 - w) + (F.col("v11") - F.col("v01")) * w) / step_x
    d_y = ((F.col("v01") - F.col("v00")) * (1 - u) + (F.col("v11") - F.col("v10")) * u) / step_y
    return placed.join(cells, ["i", "j"], "left").withColumns({"d_x": d_x, "d_y": d_y}).drop("i", "j", "v00", "v10", "v01", "v11")


def incidence(slowness: Column, speed_km_s: float) -> Column:
    """Angle from the vertical in degrees of a ray of a slowness in seconds a degree; null where none can have it."""
    ratio = slowness / (math.pi / 180 * geo.EARTH_RADIUS_KM) * speed_km_s
    return F.when(F.abs(ratio) <= 1, F.degrees(F.asin(ratio)))


def inverted(x: Column, nodes: list[tuple[float, float]]) -> Column:
    """Where a falling piecewise linear function given by nodes (place, value) takes the value x; its ends beyond its range."""
    out = F.lit(nodes[-1][0])
    for (a, fa), (b, fb) in reversed(list(zip(nodes, nodes[1:]))):
        out = F.when(x >= fb, a + (fa - F.least(x, F.lit(fa))) / (fa - fb) * (b - a)).otherwise(out)
    return out


def located_by_slowness(lon: str, lat: str, azimuth: str, slowness: str, nodes: list[tuple[float, float]]) -> tuple[Column, Column, Column]:
    """(longitude, latitude, degrees): where a detection's back azimuth and slowness point from its station, by the inverted table of slowness
    over distance."""
    degrees = inverted(F.col(slowness), nodes)
    return *geo.destination(lon, lat, azimuth, geo.deg_to_km(degrees)), degrees


def depth_log_density(depth: Column) -> Column:
    """Log-density of the depth prior in km; null outside of 0 .. DEEPEST."""
    surface = F.exp(-depth / DEPTH_MEAN) / DEPTH_MEAN
    z = (depth - DEPTH_SHIFT) / DEPTH_SCALE
    deep = F.when(depth > DEPTH_SHIFT, F.pow(z, F.lit(DEPTH_SHAPE - 1)) * F.exp(-z) / (math.gamma(DEPTH_SHAPE) * DEPTH_SCALE)).otherwise(0.0)
    return F.when(depth.between(0, DEEPEST), F.ln(DEPTH_SURFACE * surface + (1 - DEPTH_SURFACE) * deep))


def location_log_density(rows: DataFrame, nodes: DataFrame, n_lon: int, n_z: int) -> DataFrame:
    """Adds lp: log-density of (lon, lat, depth) from nodes (i, j, p) on a grid over longitude, which wraps, and z = 1 + sin(latitude), plus that of the
    depth. A place is between four nodes; those beyond the last row of z are the pole, nodes of j = n_z, all of one p."""
    lon_step, z_step = 360.0 / n_lon, 2.0 / n_z
    z = 1 + F.sin(F.radians("lat"))
    x = F.pmod(F.col("lon") + 180, F.lit(360.0))
    placed = rows.withColumns({"_u": x / lon_step, "_w": z / z_step}).withColumns({"_i": F.floor("_u"), "_j": F.least(F.floor("_w"), F.lit(n_z - 1))})
    corner = lambda di, dj, name: nodes.select(F.pmod(F.col("i") - di, F.lit(n_lon)).alias("_i"), (F.col("j") - dj).alias("_j"), F.col("p").alias(name))
    for di, dj, name in ((0, 0, "_p00"), (1, 0, "_p10"), (0, 1, "_p01"), (1, 1, "_p11")):
        placed = placed.join(corner(di, dj, name), ["_i", "_j"], "left")
    u, w = F.col("_u") - F.col("_i"), F.col("_w") - F.col("_j")
    p = F.col("_p00") * (1 - u) * (1 - w) + F.col("_p10") * u * (1 - w) + F.col("_p01") * (1 - u) * w + F.col("_p11") * u * w
    lp = F.coalesce(F.ln(p) - math.log(lon_step) - math.log(z_step) + depth_log_density(F.col("depth")), F.lit(OUTSIDE))
    return placed.withColumn("lp", lp).select(*rows.columns, "lp")
