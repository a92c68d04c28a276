"""Joins that Catalyst has no strategy for, as equi-joins on buckets with exact residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, width: float, condition: Column | None = None, how: str = "inner", keys: list[str] | None = None) -> DataFrame:
    """Rows with |left_on - right_on| <= width (and equal keys, and the condition).

    Each right row goes to the bucket of its value and to both neighbours; each left row to its own. So a pair meets
    once, in an equi-join that shuffles and spreads like any other. Column names of the sides have to differ, but for
    the keys. how is inner, left_semi, left_anti or left.

    The join is a sort-merge join at any size: Spark takes repeated rows of a small file for a small table, and a broadcast
    of them goes through the driver.
    """
    bucket = F.floor(F.col(left_on) / width).cast("long")
    spread = F.explode(F.sequence(F.floor(F.col(right_on) / width).cast("long") - 1, F.floor(F.col(right_on) / width).cast("long") + 1))
    on = list(keys or [])
    a = left.withColumn("_bucket", bucket)
    b = right.withColumn("_bucket", spread)
    for k in on:
        b = b.withColumnRenamed(k, f"_r_{k}")
    b = b.withColumnRenamed("_bucket", "_r_bucket")
    test = (F.col("_bucket") == F.col("_r_bucket")) & (F.abs(F.col(left_on) - F.col(right_on)) <= width)
    for k in on:
        test = test & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        test = test & condition
    out = a.join(b.hint("merge"), test, how)
    return out.drop("_bucket", "_r_bucket", *(f"_r_{k}" for k in on))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bucket: float, condition: Column | None = None, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs whose closed intervals overlap. Both sides go to every bucket they touch; a pair counts only in the first
    bucket that both touch, so it appears once. bucket should be about the usual length of the longer side."""
    if how not in ("inner", "left_semi"):
        raise ValueError(how)
    buckets = lambda span: F.explode(F.sequence(F.floor(F.col(span[0]) / bucket).cast("long"), F.floor(F.col(span[1]) / bucket).cast("long")))
    a, b = left.withColumn("_bucket", buckets(left_span)), right.withColumn("_r_bucket", buckets(right_span))
    for k in keys or []:
        b = b.withColumnRenamed(k, f"_r_{k}")
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / bucket).cast("long")
    test = (F.col("_bucket") == F.col("_r_bucket")) & (F.col("_bucket") == first) & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    for k in keys or []:
        test = test & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        test = test & condition
    out = a.join(b.hint("merge"), test, "inner").drop("_bucket", "_r_bucket", *(f"_r_{k}" for k in keys or []))
    return out if how == "inner" else out.select(*left.columns).distinct()


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, left_on: str, right_on: str, width: float, cost: Column, right_id: str) -> DataFrame:
    """For each left row the right row of least cost within the band; of equals that of the least id. Left rows without
    any come out with nulls."""
    near = band_join(left, right, left_on, right_on, width)
    best = near.groupBy(left_id).agg(F.min(F.struct(cost.alias("cost"), F.col(right_id).alias(right_id))).alias("_best"))
    return left.join(best, left_id, "left").select(*left.columns, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.cost").alias("cost"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the value of the latest right row of its key at or before its time, whatever a key's share of the rows.
    Of right rows at one time that of the greatest value counts."""
    from .ranks import latest

    return latest(left, right, key, left_time, right_time, value)


#: Bins that go with the plan; more are joined.
MOST_BINS = 1000


def bin_lookup(rows: DataFrame, bins: DataFrame, on: str, row_id: str, low: str = "low", high: str = "high", order: str = "bin") -> DataFrame:
    """Adds the columns of the first bin (by order) with low <= on < high, nulls where there is none. Up to MOST_BINS bins are a list in the plan, so nothing is joined; more meet the rows
    in a join whose hits come back by row_id."""
    extra = [c for c in bins.columns if c not in (low, high)]
    few = bins.orderBy(order).limit(MOST_BINS + 1).collect()
    if len(few) <= MOST_BINS:
        types = {f.name: f.dataType for f in bins.schema.fields}
        listed = F.array(*(F.struct(*(F.lit(r[c]).cast(types[c]).alias(c) for c in bins.columns)) for r in few)) if few else F.array().cast(f"array<{bins.schema.simpleString()}>")
        hit = F.get(F.filter(listed, lambda b: (F.col(on) >= b[low]) & (F.col(on) < b[high])), 0)
        return rows.withColumn("_bin", hit).select(*rows.columns, *(F.col("_bin").getField(c).alias(c) for c in extra))
    hit = rows.select(row_id, on).join(bins, (F.col(on) >= F.col(low)) & (F.col(on) < F.col(high))).groupBy(row_id).agg(F.min_by(F.struct(*extra), order).alias("_bin"))
    return rows.join(hit, row_id, "left").select(*rows.columns, *(F.col(f"_bin.{c}").alias(c) for c in extra))
