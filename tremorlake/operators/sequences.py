"""Order-dependent operators: ordinals, gaps, islands, running counts, windows of sums, suppression of duplicates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import geo

from .graphs import components
from .joins import band_join
from .lineage import checkpointed


def ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Place from 0 within keys. Without keys the places of a large table are made from range partitions: each knows how
    many rows come before it, so no task sorts everything."""
    if keys:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written out once: the partitions that are counted have to be those that are numbered
    ranged = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds to each row the sums of columns (new name -> column) over it and all rows before it in a whole table, from range partitions:
    each knows the sums of those before it, so no task sorts everything. The order has no ties, or they get any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    ranged = checkpointed(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    total = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts_of = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))  # a row for each partition
    before = parts_of.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(total), F.lit(0)).alias(f"_b_{n}") for n in sums))
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumns({f"_w_{n}": F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return run.select(*rows.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def gaps(rows: DataFrame, keys: list[str], t: str, tie: str) -> DataFrame:
    return rows.withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, tie)))


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: float, tie: str | None = None) -> DataFrame:
    """Adds island: intervals less than gap apart (from the furthest end so far) share one; numbered from 0 in each key."""
    w = Window.partitionBy(*keys).orderBy(*([start, end] + ([tie] if tie else [])))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0)
    marked = rows.withColumn("_open", opens)
    return marked.withColumn("island", (F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint")).drop("_open")


def merged_blocks(rows: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """One row for each island: its first start and last end."""
    return islands(rows, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def true_blocks(rows: DataFrame, keys: list[str], index: str, flag: Column) -> DataFrame:
    """(keys, first, end): runs of rows with neighbouring indices for which flag holds; end is exclusive."""
    w = Window.partitionBy(*keys).orderBy(index)
    kept = rows.where(flag).withColumn("_run", F.col(index) - F.row_number().over(w))
    return kept.groupBy(*keys, "_run").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("end")).drop("_run")


def running_roc(rows: DataFrame, score: str, is_true: str, total_true: int | Column) -> DataFrame:
    """Precision and recall at each score from the highest on: counts by score first, so ties are one point. total_true is a
    number or a scalar subquery."""
    counts = rows.groupBy(score).agg(F.count_if(F.col(is_true)).alias("t"), F.count("*").alias("n"))
    run = running_sums(counts, [score], {"n_true": "t", "n_all": "n"}, descending=True).select(score, "n_true", "n_all")
    return run.withColumns({"precision": F.col("n_true") / F.col("n_all"), "recall": F.col("n_true") / F.lit(total_true)})


def azimuth_gap(rows: DataFrame, keys: list[str], azi: str) -> DataFrame:
    """Largest gap between neighbouring azimuths around the circle; 360 for a single one."""
    w = Window.partitionBy(*keys).orderBy(azi)
    every = Window.partitionBy(*keys)
    nxt = F.coalesce(F.lead(azi).over(w), F.min(azi).over(every) + 360)
    return rows.withColumn("_gap", nxt - F.col(azi)).groupBy(*keys).agg(F.max("_gap").alias("gap"))


def sta_lta(rows: DataFrame, keys: list[str], order: list[str], x: str, short: int, long: int) -> DataFrame:
    """Ratio of the mean squares of the last short and the last long rows; null before there are long rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    square = F.col(x) * F.col(x)
    sta, lta = F.avg(square).over(w.rowsBetween(-short + 1, 0)), F.avg(square).over(w.rowsBetween(-long + 1, 0))
    return rows.withColumn("ratio", F.when(F.row_number().over(w) >= long, F.try_divide(sta, lta)))


def _degrees(a, b) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[0] - b[0]) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


#: Events of clusters that share a task; clusters never meet, so going through several at once changes nothing.
CLUSTER_ROWS = 20_000


def _in_clusters(events: DataFrame, seconds: float, near: Column, run) -> DataFrame:
    """run on every cluster of events that pairs within seconds and ``near`` connect (columns of the second event begin with o_). Only events of a
    cluster's pairs can meet, so events without any stand as they are and clusters are dealt by hash."""
    names = events.columns
    slim = events.select("id", "t", "lon", "lat")
    other = slim.toDF("o_id", "o_t", "o_lon", "o_lat")
    pairs = band_join(slim, other, "t", "o_t", seconds, (F.col("id") < F.col("o_id")) & near)
    comps = checkpointed(components(pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b"))))
    tasks = max(1, -(-comps.count() // CLUSTER_ROWS))
    rows = events.join(comps, "id").withColumn("_task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    return events.join(comps, "id", "left_anti").select(*names).unionByName(rows.groupBy("_task").applyInPandas(run, events.schema))


def _clusters(rows: pd.DataFrame):
    rows = rows.sort_values(["component", "t", "id"], kind="stable").reset_index(drop=True)
    columns = [rows[c].tolist() for c in ("component", "t", "score")]
    return rows, *columns, list(zip(rows["lon"], rows["lat"]))


def suppress_in_order(events: DataFrame, seconds: float = 50.0, degrees: float = 5.0) -> DataFrame:
    """Greedy suppression in order of time. Each event that stands looks at later ones within seconds and degrees,
    dropped or not: it drops those of lower score, and drops itself at the first of equal or higher score."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, comp, t, score, at = _clusters(rows)
        gone = [False] * len(rows)
        for i in range(len(rows)):
            if gone[i]:
                continue
            for j in range(i + 1, len(rows)):
                if comp[j] != comp[i] or t[j] - t[i] > seconds:
                    break
                if _degrees(at[i], at[j]) < degrees:
                    if score[i] > score[j]:
                        gone[j] = True
                    else:
                        gone[i] = True
                        break
        return rows[[not g for g in gone]][names]

    names = events.columns
    return _in_clusters(events, seconds, geo.dist_deg("lon", "lat", "o_lon", "o_lat") < degrees + 1e-6, run)


def suppress_to_fixpoint(events: DataFrame, seconds: float = 50.0, km: float = 60.0) -> DataFrame:
    """Passes until nothing changes: each live event meets its first live successor within seconds and km, and the one
    of lower score goes (of equals the later one)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, comp, t, score, at = _clusters(rows)
        live, changed = [True] * len(rows), True
        while changed:
            changed = False
            for i in range(len(rows)):
                if not live[i]:
                    continue
                for j in range(i + 1, len(rows)):
                    if comp[j] != comp[i] or t[j] - t[i] > seconds:
                        break
                    if live[j] and math.radians(_degrees(at[i], at[j])) * geo.EARTH_RADIUS_KM <= km:
                        live[i if score[j] > score[i] else j] = False
                        changed = True
                        break
        return rows[live][names]

    names = events.columns
    return _in_clusters(events, seconds, geo.dist_km("lon", "lat", "o_lon", "o_lat") <= km + 1e-3, run)


def folds(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: k folds drawn by hash, the same each time, without sorting the table."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))
