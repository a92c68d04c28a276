"""Exports, runs, edits of tables, periods and lookups as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake.functions import tables
from tremorlake.sources import bulletins as io

from . import views as v
from .registry import query


@query("s03_export_keys", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def s03(spark, sf):
    keys = v.table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("user_id"))
    return v.table(spark, sf, "events").join(keys, "user_id", "left_semi").select("event_id", "user_id")


@query("s04_export_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def s04(spark, sf):
    count = lambda n: v.table(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("orders").unionByName(count("lineitem")).unionByName(count("events"))


@query("s06_run_remap", "SELECT (SELECT max(l_suppkey) + 1 FROM lineitem) AS runid, l_orderkey FROM lineitem WHERE l_suppkey = 5")
def s06(spark, sf):
    li = v.table(spark, sf, "lineitem")
    new = li.agg((F.coalesce(F.max("l_suppkey"), F.lit(0)) + 1).alias("runid"))
    return li.where("l_suppkey = 5").crossJoin(F.broadcast(new)).select("runid", "l_orderkey")  # one row of ids


@query("s13_source_by_date", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'sac' ELSE 'ims' END AS source FROM events")
def s13(spark, sf):
    e, cut = v.table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    return e.where(F.col("ts") < cut).select("event_id", F.lit("sac").alias("source")).unionByName(e.where(F.col("ts") >= cut).select("event_id", F.lit("ims").alias("source")))


@query("s15_segments", v.with_views("arrival") + "SELECT sta, count(*) AS n, round(min(time), 3) AS first FROM arrival WHERE sta IN (3, 5, 8) AND time BETWEEN 1704067200 AND 1705000000 GROUP BY sta")
def s15(spark, sf):
    wanted = spark.createDataFrame([(3,), (5,), (8,)], "sta long")
    return v.arrival(spark, sf).where("time BETWEEN 1704067200 AND 1705000000").join(wanted, "sta").groupBy("sta").agg(F.count("*").alias("n"), F.round(F.min("time"), 3).alias("first"))


@query("s16_event_windows", v.with_views("assoc", "arrival") + "SELECT orid, round(min(time) - 10, 3) AS stime, round(max(time) + 200, 3) AS etime FROM assoc JOIN arrival USING (arid) GROUP BY orid")
def s16(spark, sf):
    both = v.assoc(spark, sf).select("orid", "arid").join(v.arrival(spark, sf).select("arid", "time"), "arid")
    return both.groupBy("orid").agg(F.round(F.min("time") - 10, 3).alias("stime"), F.round(F.max("time") + 200, 3).alias("etime"))


@query("s17_view", v.with_views("arrival") + "SELECT arid FROM arrival WHERE delaz > 0 AND delslo > 0 AND snr > 0 AND iphase = 'error'")
def s17(spark, sf):
    v.arrival(spark, sf).createOrReplaceTempView("arrival_all")
    spark.sql("CREATE OR REPLACE TEMP VIEW arrival_net AS SELECT * FROM arrival_all WHERE delaz > 0 AND delslo > 0 AND snr > 0")
    return spark.sql("SELECT arid FROM arrival_net WHERE iphase = 'error'")


@query("s19_update_delete", "SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'approved' ELSE event_type END AS event_type FROM events WHERE event_id % 77 <> 1")
def s19(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "event_type")
    changes = e.where("event_id % 100 = 0").select("event_id", F.lit("approved").alias("event_type"))
    return io.without(io.updated(e, changes, "event_id"), e.where("event_id % 77 = 1"), "event_id")


@query("s20_cloned_period", v.with_views("origin", "assoc", "arrival") + "SELECT orid, mb FROM origin WHERE orid IN (SELECT orid FROM assoc JOIN arrival USING (arid) WHERE sta = 9 AND time BETWEEN 1704067200 AND 1706000000)")
def s20(spark, sf):
    return io.cloned_period(v.origin(spark, sf), v.assoc(spark, sf), v.arrival(spark, sf), 9, 1704067200, 1706000000)["origin"].select("orid", "mb")


@query("s21_merged_periods", v.with_views("arrival") + "SELECT arid FROM arrival WHERE arid % 2 = 0 AND time >= 1704067200 AND time < 1705000000 UNION ALL SELECT arid FROM arrival WHERE arid % 2 = 1 AND time >= 1705000000 AND time < 1706000000")
def s21(spark, sf):
    a = v.arrival(spark, sf)
    return io.merged_states([a.where("arid % 2 = 0"), a.where("arid % 2 = 1")], [(1704067200, 1705000000), (1705000000, 1706000000)]).select("arid")


def sloping_table(spark):
    # a table of nodes that is bilinear in itself, so that interpolation has to be exact; it goes below zero
    nodes = spark.range(19 * 8).select((F.col("id") % 19 * 10.0).alias("d"), (F.floor(F.col("id") / 19) * 100.0).alias("z")).withColumn("tt", 3 + F.col("d") * 8 - F.col("z") * 0.01 + F.col("d") * F.col("z") * 0.0005)
    return tables.grid_cells(nodes, "d", "z", "tt", 10.0, 100.0, negative_is_missing=False)


def distances(spark, sf):
    return v.table(spark, sf, "events").select("event_id", (F.col("value") * 0.5).alias("d"), (F.col("event_id") % 800).cast("double").alias("z"))


@query("x16_travel_time", "SELECT event_id, round(CASE WHEN d > 180 OR z > 700 THEN -1 ELSE 3 + d * 8 - z * 0.01 + d * z * 0.0005 END, 4) AS tt FROM (SELECT event_id, value * 0.5 AS d, (event_id % 800)::DOUBLE AS z FROM events)")
def x16(spark, sf):
    # values are multiples of 0.0000025, so one in forty is a tie of the fourth decimal; coefficients without the error of their last bits
    # let it fall as the formula of the nodes does, rounded half away from zero as a double and not, as F.round does, as a decimal text
    cells = tables.cell_coefficients(sloping_table(spark), 10.0, 100.0, decimals=10)
    out = tables.by_coefficients(distances(spark, sf), cells, "d", "z", 10.0, 100.0, 18, 7, "tt")
    return out.select("event_id", (F.signum("tt") * F.floor(F.abs("tt") * 1e4 + 0.5) / 1e4).alias("tt"))


@query("x16_corner_weights", "SELECT event_id, round(CASE WHEN d > 180 OR z > 700 THEN -1 ELSE 3 + d * 8 - z * 0.01 + d * z * 0.0005 END, 8) AS tt FROM (SELECT event_id, value * 0.5 AS d, (event_id % 800)::DOUBLE AS z FROM events)")
def x16_corners(spark, sf):
    return tables.bilinear(distances(spark, sf), sloping_table(spark), "d", "z", 10.0, 100.0, 18, 7, "tt").select("event_id", F.round("tt", 8).alias("tt"))


@query("x16_missing_nodes", "SELECT event_id, round(CASE WHEN d > 180 OR z > 700 OR (least(floor(d / 10), 17) IN (3, 4) AND least(floor(z / 100), 6) IN (1, 2)) THEN -1 ELSE 3 + d * 8 + z * 0.01 + d * z * 0.0005 END, 8) AS tt FROM (SELECT event_id, value * 0.5 AS d, (event_id % 800)::DOUBLE AS z FROM events)")
def x16_missing(spark, sf):
    # the node at 40 degrees and 200 km has no value, so the four cells around it have none
    value = F.when((F.col("d") == 40) & (F.col("z") == 200), -1.0).otherwise(3 + F.col("d") * 8 + F.col("z") * 0.01 + F.col("d") * F.col("z") * 0.0005)
    nodes = spark.range(19 * 8).select((F.col("id") % 19 * 10.0).alias("d"), (F.floor(F.col("id") / 19) * 100.0).alias("z")).withColumn("tt", value)
    return tables.bilinear(distances(spark, sf), tables.grid_cells(nodes, "d", "z", "tt", 10.0, 100.0), "d", "z", 10.0, 100.0, 18, 7, "tt").select("event_id", F.round("tt", 8).alias("tt"))


@query("t14_grown_mask", v.with_views("arrival") + ", r AS (SELECT sta, arid, max(CASE WHEN amp > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY sta ORDER BY time, arid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM arrival) SELECT arid, m = 1 AS masked FROM r")
def t14(spark, sf):
    w = Window.partitionBy("sta").orderBy("time", "arid").rowsBetween(-2, 2)
    return v.arrival(spark, sf).select("arid", F.max(F.col("amp") > 150).over(w).alias("masked"))


@query("a12_cluster_distances", v.with_views("origin") + ", c AS (SELECT * FROM (VALUES (0, -100.0), (1, 0.0), (2, 100.0)) AS t(cluster, clon)), d AS (SELECT orid, min(abs(lon - clon)) AS d FROM origin, c GROUP BY 1), k AS (SELECT orid, min(cluster) AS cluster, min(d) AS d FROM d JOIN origin USING (orid) JOIN c ON abs(lon - clon) = d GROUP BY 1) SELECT cluster, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean FROM k GROUP BY 1")
def a12(spark, sf):
    centers = F.array(*(F.struct(F.abs(F.col("lon") - x).alias("d"), F.lit(k).alias("cluster")) for k, x in enumerate((-100.0, 0.0, 100.0))))
    best = v.origin(spark, sf).select(F.array_min(centers).alias("b"))
    return best.groupBy("b.cluster").agg(F.min("b.d").alias("least"), F.max("b.d").alias("most"), F.round(F.avg("b.d"), 6).alias("mean"))
