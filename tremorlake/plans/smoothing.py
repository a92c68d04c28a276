"""Regression by neighbours and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import smoothing

from . import views as v
from .registry import query

_ROWS = v.with_views("origin") + ", q AS (SELECT s_suppkey AS qid, 2 + s_suppkey % 40 / 10.0 AS qx FROM supplier)"


def _places(spark, sf):
    return v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), (2 + F.col("s_suppkey") % 40 / 10.0).cast("double").alias("qx"))


@query("m18_neighbours", _ROWS + ", c AS (SELECT qid, depth, row_number() OVER (PARTITION BY qid ORDER BY abs(mb - qx), mb, depth) AS k FROM q, origin) SELECT qid, round(avg(depth), 6) AS value, count(*) AS n FROM c WHERE k <= 5 GROUP BY 1")
def m18_neighbours(spark, sf):
    return smoothing.neighbour_regression(v.origin(spark, sf), _places(spark, sf), "mb", "qx", "depth", 5).select("qid", F.round("value", 6).alias("value"), "n")


@query("m18_kernels", _ROWS + ", p AS (SELECT mb, avg(depth) AS y, count(*) AS n FROM origin GROUP BY 1), d AS (SELECT *, list_sort([mb - lag(mb) OVER o, mb - lag(mb, 2) OVER o, lead(mb) OVER o - mb, lead(mb, 2) OVER o - mb], 'ASC', 'NULLS LAST') AS l FROM p WINDOW o AS (ORDER BY mb)), w AS (SELECT mb, y, n, (l[1] + l[2]) / 3 AS w FROM d), k AS (SELECT qid, y, n * exp(-0.5 * pow((mb - qx) / w, 2)) / sqrt(2 * pi() * w) AS k FROM q JOIN w ON abs(mb - qx) <= 9 * w) SELECT qid, round(sum(k * y) / sum(k), 6) AS value FROM k GROUP BY 1")
def m18_kernels(spark, sf):
    return smoothing.kernel_regression(v.origin(spark, sf), _places(spark, sf), "mb", "qx", "depth").select("qid", F.round("value", 6).alias("value"))
