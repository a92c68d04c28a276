"""Distance joins on the sphere, as equi-joins on cells of about equal area.

Latitudes are cut into rings as high as the distance asked for, and each ring into as many cells as are about that wide. A left row has its own cell; a
right row goes to every cell that its cap can touch: in its ring and those beside it, the cells within the cap's greatest width in longitude, or
all of a ring's if a pole is in the cap. Longitudes wrap, so the date line is no border. A pair within the distance so meets exactly once, and the pairs that
meet are a few times those that are near, anywhere on the sphere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo

from .joins import band_join
from .lineage import checkpointed

#: Degrees added to caps when cells are chosen, for what rounding does to distances.
_SLACK = 1e-6


def ring_cells(ring: Column, height: float) -> Column:
    """How many cells a ring has: as many as fit along its longest circle of latitude."""
    low = ring * height - 90
    nearest = F.when((low <= 0) & (low + height >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(low + height)))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(nearest)) * (360 / height))).cast("long")


def ring_of(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height).cast("long")


def cell_of(lon: Column, lat: Column, height: float) -> Column:
    """(ring, cell) of a point."""
    ring = ring_of(lat, height)
    n = ring_cells(ring, height)
    return F.struct(ring.alias("ring"), F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n).alias("cell"))


def cells_near(lon: Column, lat: Column, degrees: float) -> Column:
    """The cells, as high as degrees, that points within degrees of a point can be in, each once."""
    reach = degrees + _SLACK
    over_pole = F.abs(lat) + reach >= 90
    width = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians(lat))))) + _SLACK)

    def of_ring(ring):
        n = ring_cells(ring, degrees)
        first = F.floor((lon - width + 180) / 360 * n).cast("long")
        last = F.least(F.floor((lon + width + 180) / 360 * n).cast("long"), first + n - 1)
        first = F.when(over_pole, F.lit(0).cast("long")).otherwise(first)
        last = F.when(over_pole, n - 1).otherwise(last)
        return F.transform(F.sequence(first, last), lambda c: F.struct(ring.alias("ring"), F.pmod(c, n).alias("cell")))

    return F.flatten(F.transform(F.sequence(ring_of(lat - reach, degrees), ring_of(lat + reach, degrees)), of_ring))


def near_join(left: DataFrame, right: DataFrame, degrees: float, condition: Column | None = None, how: str = "inner", left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("o_lon", "o_lat"), keys: list[str] | None = None, within: Column | None = None, times: tuple[str, str] | None = None, seconds: float | None = None) -> DataFrame:
    """Rows at most degrees apart (with equal keys, at most seconds apart if times are named, and the condition). ``within`` replaces the
    test of the distance by one that implies it, so that a query may say it in its own words. Column names of the sides differ, but for the keys. how
    is inner, left, left_semi or left_anti. The right side should be the smaller one, as its rows are repeated (about nine times, thrice that with times)."""
    if not 0 < degrees <= 180:
        raise ValueError(degrees)
    a = left.withColumn("_cell", cell_of(F.col(left_at[0]), F.col(left_at[1]), degrees))
    b = right.withColumn("_o_cell", F.explode(cells_near(F.col(right_at[0]), F.col(right_at[1]), degrees)))
    test = F.col("_cell") == F.col("_o_cell")
    if times:
        step = lambda c: F.floor(F.col(c) / seconds).cast("long")
        a = a.withColumn("_step", step(times[0]))
        b = b.withColumn("_o_step", F.explode(F.sequence(step(times[1]) - 1, step(times[1]) + 1)))
        test &= (F.col("_step") == F.col("_o_step")) & (F.abs(F.col(times[0]) - F.col(times[1])) <= seconds)
    for k in keys or []:
        b = b.withColumnRenamed(k, f"_o_{k}")
        test &= F.col(k) == F.col(f"_o_{k}")
    test &= within if within is not None else geo.dist_deg(*left_at, *right_at) <= degrees
    if condition is not None:
        test &= condition
    # never by broadcast: the repeated rows are many more than the table's file tells
    return a.join(b.hint("merge"), test, how).drop("_cell", "_step", "_o_cell", "_o_step", *(f"_o_{k}" for k in keys or []))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, times: tuple[str, str], seconds: float, seconds_a_degree: float, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("o_lon", "o_lat")) -> DataFrame:
    """For each left row the right row at most seconds away of least cost, the degrees between them and a degree for each seconds_a_degree; of equals that of the least id. Left rows
    without any come out with nulls.

    Rounds of growing reach: what costs no more than a reach is within it in space and in time, so a left row that finds any is done. The first reach is one that a few right rows cost less
    than, by their number and period, so that rows looked at grow as the tables do, not as pairs in the band. The last round takes the whole band, for the rows that are left."""
    cost = geo.dist_deg(*left_at, *right_at) + F.abs(F.col(times[0]) - F.col(times[1])) / seconds_a_degree
    least = F.min(F.struct(cost.alias("cost"), F.col(right_id).alias(right_id))).alias("_best")
    n, span = right.agg(F.count(times[1]), F.max(times[1]) - F.min(times[1])).first()
    rate = n / max(span or 0.0, seconds)
    reach = (24 / max(rate * 2 * seconds_a_degree * (3.141592653589793 / 180) ** 2, 1e-12)) ** (1 / 3)
    todo, found = left.where(F.col(left_id).isNotNull()), None
    while reach * seconds_a_degree < seconds and reach < 60:
        near = near_join(todo, right, reach, left_at=left_at, right_at=right_at, within=cost <= reach, times=times, seconds=reach * seconds_a_degree * (1 + 1e-9))
        best = checkpointed(near.groupBy(left_id).agg(least))
        todo = checkpointed(todo.join(best.select(left_id), left_id, "left_anti"))
        found, reach = best if found is None else found.unionByName(best), reach * 3
    last = band_join(todo, right, *times, seconds).groupBy(left_id).agg(least)
    best = last if found is None else found.unionByName(last)
    return left.join(best, left_id, "left").select(*left.columns, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.cost").alias("cost"))
