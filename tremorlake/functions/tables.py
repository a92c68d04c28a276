"""Lookups in small tables of nodes: bilinear interpolation as joins with dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_cells(nodes: DataFrame, x: str, y: str, value: str, step_x: float, step_y: float, negative_is_missing: bool = True) -> DataFrame:
    """One row per cell of a regular grid of nodes (x, y, value): its indices and four corners. A missing value is null, or negative in tables
    whose values can't be."""
    n = nodes.select(F.round(F.col(x) / step_x).cast("long").alias("i"), F.round(F.col(y) / step_y).cast("long").alias("j"), (F.when(F.col(value) >= 0, F.col(value)) if negative_is_missing else F.col(value)).alias("v"))
    corner = lambda di, dj, name: n.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("v").alias(name))
    return corner(0, 0, "v00").join(corner(1, 0, "v10"), ["i", "j"]).join(corner(0, 1, "v01"), ["i", "j"]).join(corner(1, 1, "v11"), ["i", "j"])


def cell_of(c: str, step: float, n: int) -> Column:
    """Index of the cell that a value is in, null outside; the upper edge belongs to the last cell."""
    return F.when((F.col(c) >= 0) & (F.col(c) <= step * n), F.least(F.floor(F.col(c) / step), F.lit(n - 1)))


def bilinear(rows: DataFrame, cells: DataFrame, x: str, y: str, step_x: float, step_y: float, n_x: int, n_y: int, name: str) -> DataFrame:
    """Adds the interpolated value; -1 outside the grid or where a corner is missing. A value on the upper edge belongs to the
    last cell."""
    placed = rows.withColumns({"i": cell_of(x, step_x, n_x), "j": cell_of(y, step_y, n_y)})
    u, w = F.col(x) / step_x - F.col("i"), F.col(y) / step_y - F.col("j")
    value = F.col("v00") * (1 - u) * (1 - w) + F.col("v10") * u * (1 - w) + F.col("v01") * (1 - u) * w + F.col("v11") * u * w
    return placed.join(cells, ["i", "j"], "left").withColumn(name, F.coalesce(value, F.lit(-1.0))).drop("i", "j", "v00", "v10", "v01", "v11")


def cell_coefficients(cells: DataFrame, step_x: float, step_y: float, decimals: int | None = None) -> DataFrame:
    """The polynomial c0 + c1 x + c2 y + c3 x y of every cell of ``grid_cells``, null where a corner is missing. ``decimals`` rounds the
    coefficients, for tables that are known to have no more."""
    x, y = F.col("i") * F.lit(step_x), F.col("j") * F.lit(step_y)
    c3 = (F.col("v11") - F.col("v10") - F.col("v01") + F.col("v00")) / (step_x * step_y)
    c1, c2 = (F.col("v10") - F.col("v00")) / step_x - c3 * y, (F.col("v01") - F.col("v00")) / step_y - c3 * x
    c0 = F.col("v00") - c1 * x - c2 * y - c3 * x * y
    tidy = (lambda c: c) if decimals is None else (lambda c: F.round(c, decimals))
    return cells.select("i", "j", *(tidy(c).alias(f"c{k}") for k, c in enumerate((c0, c1, c2, c3))))


def by_coefficients(rows: DataFrame, coefficients: DataFrame, x: str, y: str, step_x: float, step_y: float, n_x: int, n_y: int, name: str) -> DataFrame:
    """``bilinear`` with the polynomials of ``cell_coefficients``."""
    placed = rows.withColumns({"i": cell_of(x, step_x, n_x), "j": cell_of(y, step_y, n_y)})
    value = F.col("c0") + F.col(x) * F.col("c1") + F.col(y) * F.col("c2") + F.col(x) * F.col(y) * F.col("c3")
    return placed.join(coefficients, ["i", "j"], "left").withColumn(name, F.coalesce(value, F.lit(-1.0))).drop("i", "j", "c0", "c1", "c2", "c3")
