"""Regression by neighbours and by kernels over one column, for any number of rows at any density.

Neighbours are found by rank, not by a width that has to be guessed: a query's place among the ordered rows is looked up, and its nearest rows lie a few ranks from there. Rows with a null
place or value count for nothing; queries with a null place have no neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .ranks import latest
from .sequences import ordinal


def nearest(rows: DataFrame, queries: DataFrame, x: str, qx: str, y: str, k: int, qid: str = "qid") -> DataFrame:
    """(qid, x, y, rank): the k rows nearest to each query, fewer only where there are fewer rows. Of equals the smaller x, then the smaller y, comes first. Queries have an id each."""
    kept = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).alias("_y")).dropna()
    ranked = ordinal(kept, [], ["_x", "_y"], "_rank")
    first = ranked.groupBy("_x").agg(F.min("_rank").alias("_first"))
    # k rows of a place are as many as any query can use, so the last 2 k ranks below it hold those that it needs
    few = ranked.join(first, "_x").where(F.col("_rank") - F.col("_first") < k).select("_x", "_y")
    places = checkpointed(ordinal(few, [], ["_x", "_y"], "_rank").withColumn("_all", F.lit(0)))
    asked = queries.select(F.col(qid).alias("_qid"), F.col(qx).cast("double").alias("_q"), F.lit(0).alias("_all")).where("_q IS NOT NULL")
    found = latest(asked, places.select("_all", F.col("_x").alias("_t"), F.col("_rank").alias("_below")), "_all", "_q", "_t", "_below")
    below = F.coalesce("_below", F.lit(-1))
    looked = found.select("_qid", "_q", F.explode(F.sequence(below - 2 * k + 1, below + k)).alias("_rank")).where("_rank >= 0")
    near = looked.join(places.select("_rank", "_x", "_y"), "_rank")
    order = Window.partitionBy("_qid").orderBy(F.abs(F.col("_x") - F.col("_q")), "_x", "_y")  # 3 k rows a query
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("_qid").alias(qid), F.col("_x").alias(x), F.col("_y").alias(y), "rank")


def neighbour_regression(rows: DataFrame, queries: DataFrame, x: str, qx: str, y: str, k: int, qid: str = "qid") -> DataFrame:
    """(qid, value, n): the mean of the k nearest rows."""
    return nearest(rows, queries, x, qx, y, k, qid).groupBy(qid).agg(F.avg(y).alias("value"), F.count("*").alias("n"))


def with_widths(places: DataFrame, x: str, k: int = 3) -> DataFrame:
    """Adds width: the mean distance from each of the places, which differ, to the k nearest, itself among them; 1 where there is no other."""
    points = places.select(F.col(x).alias("_p"), F.col(x).alias("_v"))
    own = nearest(points, points.select(F.col("_p").alias("_id")), "_p", "_id", "_v", k, "_id")
    widths = own.groupBy(F.col("_id").alias(x)).agg(F.avg(F.abs(F.col("_p") - F.col("_id"))).alias("width"))
    return places.join(widths, x).withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0))


def kernel_regression(rows: DataFrame, queries: DataFrame, x: str, qx: str, y: str, width: float | None = None, reach: float = 9.0, qid: str = "qid") -> DataFrame:
    """(qid, value): means of the rows weighted by normal kernels around each of their places, of one width or of the place's own (``with_widths``), each divided by the root of
    its width. Rows of one place are summed first. A kernel ends at ``reach`` widths; a query that none reaches stays out.

    Places meet queries by classes of widths, each within a factor of two: in a class it is an equi-join on buckets as wide as its kernels reach, so wide kernels don't spread narrow ones."""
    kept = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    places = kept.groupBy("_x").agg(F.avg("_y").alias("_y"), F.count("*").alias("_n"))
    wide = places.withColumn("width", F.lit(float(width))) if width is not None else with_widths(checkpointed(places), "_x")
    wide = checkpointed(wide.withColumn("_class", F.ceil(F.log2("width")).cast("int")))
    classes = sorted(r[0] for r in wide.select("_class").distinct().collect())  # exponents of doubles, of which there are 2100
    bucket = lambda c: F.floor(F.col(c) / (reach * F.pow(F.lit(2.0), F.col("_class")))).cast("long")
    right = wide.withColumn("_b", F.explode(F.sequence(bucket("_x") - 1, bucket("_x") + 1)))
    listed = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<int>")
    left = queries.select(F.col(qid).alias(qid), F.col(qx).cast("double").alias("_q")).where("_q IS NOT NULL").withColumn("_class", F.explode(listed)).withColumn("_b", bucket("_q"))
    off = (F.col("_x") - F.col("_q")) / F.col("width")
    near = left.join(right, ["_class", "_b"]).where(F.abs(off) <= reach)
    weight = F.col("_n") * F.exp(-0.5 * off * off) / F.sqrt(2 * math.pi * F.col("width"))
    return near.groupBy(qid).agg((F.sum(weight * F.col("_y")) / F.sum(weight)).alias("value"))
