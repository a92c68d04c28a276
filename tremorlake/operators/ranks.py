"""Ranks, medians and latest values within groups of any size, from range partitions.

Rows are range-partitioned by group and order, so a hot group lies in many partitions and a partition in few groups. What precedes a partition in its group (a count, a last value) comes
from a table with a row for each group of a partition. No task and no buffer holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _part and _key. Written out once: the partitions that are counted have to be those that are read."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(parts, *keys, *order).withColumn("_r_part", F.spark_partition_id()).withColumn("_r_key", F.struct(F.lit(0), *keys)))  # null keys are a group, too


def before(sizes: DataFrame) -> DataFrame:
    """(_key, _part, _k) with _start, the sum of _k in earlier partitions of the group, and _n, that in all."""
    w = Window.partitionBy("_r_key")
    start = F.coalesce(F.sum("_r_k").over(w.orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_r_start", start).withColumn("_r_n", F.sum("_r_k").over(w))


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """Adds each row's place from 1 in its group, by an order without ties, and the group's size."""
    parts = ranged(rows, keys, order)
    starts = before(parts.groupBy("_r_key", "_r_part").agg(F.count("*").alias("_r_k")))
    local = F.row_number().over(Window.partitionBy("_r_key", "_r_part").orderBy(*order))
    return parts.withColumn("_r_i", local).join(starts, ["_r_key", "_r_part"]).select(*rows.columns, (F.col("_r_i") + F.col("_r_start")).alias(rank), F.col("_r_n").alias(size))


def medians(rows: DataFrame, keys: list[str], x: str | Column, name: str = "med") -> DataFrame:
    """(keys, name): the exact median of each group, the mean of the two middle values where there are two; null where a group has no values. Equal values are one row with their number
    before anything is ordered, and of the ordered ones only the partitions that hold a middle are read again."""
    value = F.col(x) if isinstance(x, str) else x
    taken = rows.select(*keys, value.cast("double").alias("_x"))
    counts = taken.groupBy(*keys, "_x").agg(F.count("_x").alias("_c"))
    values = ranged(counts.where("_x IS NOT NULL"), keys, ["_x"])
    parts = before(values.groupBy("_r_key", "_r_part").agg(F.sum("_c").alias("_r_k")))
    low, high = F.floor((F.col("_r_n") + 1) / 2), F.floor(F.col("_r_n") / 2) + 1  # ranks of the middles
    inside = lambda r: (F.col("_r_start") < r) & (r <= F.col("_r_start") + F.col("_r_k"))
    hit = values.join(parts.where(inside(low) | inside(high)), ["_r_key", "_r_part"])
    upto = F.col("_r_start") + F.sum("_c").over(Window.partitionBy("_r_key", "_r_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    run = hit.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col("_from") < r) & (r <= F.col("_upto")), F.col("_x")))
    found = run.groupBy("_r_key").agg((0.5 * at(low) + 0.5 * at(high)).alias(name))
    groups = taken.select(*keys).distinct().withColumn("_r_key", F.struct(F.lit(0), *keys)) if keys else rows.sparkSession.range(1).select(F.struct(F.lit(0)).alias("_r_key"))
    return groups.join(found, "_r_key", "left").select(*keys, name)


def latest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the value of the latest right row of its key at or before its time. Of right rows at one time the greatest value counts; nulls are no values."""
    marked = left.withColumns({"_r_t": F.col(left_time), "_r_side": F.lit(1), "_r_v": F.lit(None).cast(right.schema[value].dataType)})
    other = right.groupBy(key, F.col(right_time).alias("_r_t")).agg(F.max(value).alias("_r_v")).withColumn("_r_side", F.lit(0))
    parts = ranged(marked.unionByName(other, allowMissingColumns=True), [key], ["_r_t", "_r_side"])
    own = F.last("_r_v", ignorenulls=True).over(Window.partitionBy("_r_key", "_r_part").orderBy("_r_t", "_r_side").rowsBetween(Window.unboundedPreceding, 0))
    lasts = parts.groupBy("_r_key", "_r_part").agg(F.max_by("_r_v", F.when(F.col("_r_v").isNotNull(), F.col("_r_t"))).alias("_r_last"))
    carry = lasts.select("_r_key", "_r_part", F.last("_r_last", ignorenulls=True).over(Window.partitionBy("_r_key").orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_r_carry"))
    out = parts.withColumn("_r_own", own).where("_r_side = 1").join(carry, ["_r_key", "_r_part"])
    return out.select(*left.columns, F.coalesce("_r_own", "_r_carry").alias(value))
