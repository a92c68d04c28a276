"""Files written and read back as queries: tables as text, runs, bulletins, binary samples, appended tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators.lineage import shared_path
from tremorlake.sources import bulletins as io

from . import views as v
from .registry import query


def _texts(df, spark, name: str) -> str:
    path = shared_path(spark, name)
    df.write.text(path)
    return path


@query("s01_text_table", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def s01(spark, sf):
    path = shared_path(spark, "table")
    rows = v.table(spark, sf, "orders").select(F.format_string('%d, %d, %.2f, "%s"', "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").alias("value"))
    header = spark.createDataFrame([("o_orderkey, o_custkey, o_totalprice, o_orderpriority",)], "value string")
    # a file with its header line for each of a few parts
    rows.write.text(f"{path}/rows")
    header.coalesce(1).write.text(f"{path}/header")
    table = io.read_table(spark, f"{path}/rows", "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", header=False)
    return table.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority")


@query("s02_exported_table", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey < 10")
def s02(spark, sf):
    path = shared_path(spark, "export")
    io.export_table(v.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "s_nationkey < 10", ["s_suppkey"])
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey long").option("header", True).csv(path)


@query("s05_saved_run", "SELECT 26 AS runid, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name FROM supplier WHERE s_nationkey = 7")
def s05(spark, sf):
    path = shared_path(spark, "run")
    runs = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("runid"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("s_name"))
    io.save_run(runs, path, 7)
    return io.load_run(spark, path, "runid int, s_suppkey long, s_name string", spark.createDataFrame([(25,)], "runid int"))


_EVENTS = "e AS (SELECT event_id, (1704067200 + event_id * 61 % 2500000) AS t, (event_id * 37 % 360 - 180.0) AS lon, (event_id * 17 % 161 - 80.0) AS lat, (event_id % 700) AS depth, (event_id % 50) / 10.0 + 2 AS mb, event_id % 3 = 0 AS has FROM events)"


def _events(spark, sf):
    e = F.col("event_id")
    at = F.timestamp_seconds(F.lit(1704067200) + e * 61 % 2500000)
    return v.table(spark, sf, "events").select(e.alias("event_id"), at.alias("at"), (e * 37 % 360 - 180).alias("lon"), (e * 17 % 161 - 80).alias("lat"), (e % 700).alias("depth"), (e % 50 / 10 + 2).alias("mb"), (e % 3 == 0).alias("has"))


@query("s07_ims_bulletin", f"WITH {_EVENTS} SELECT event_id AS eventid, t::DOUBLE AS time, lat::DOUBLE AS lat, lon::DOUBLE AS lon, depth::DOUBLE AS depth, CASE WHEN has THEN round(mb, 1) END AS mb FROM e")
def s07(spark, sf):
    lines = F.concat_ws(
        "\n",
        F.format_string("Event %d Somewhere", "event_id"),
        F.lit("   Date       Time        Err   RMS Latitude Longitude  Depth   Ndef Author"),
        F.concat(F.date_format("at", "yyyy/MM/dd HH:mm:ss.SS"), F.format_string(" %d.0 %d.0 %df 12 REB", "lat", "lon", "depth")),
        F.when(F.col("has"), F.concat(F.lit("Magnitude  Err Nsta Author\n"), F.format_string("mb %.1f 0.1 12 REB", "mb"))),
        F.lit("Sta     Dist  EvAz\nABC 12.1 33.0"),
    )
    path = _texts(_events(spark, sf).select(lines), spark, "ims")
    return io.read_ims_bulletins(spark, path).select("eventid", "time", "lat", "lon", "depth", "mb")


@query("s08_weed_bulletin", f"WITH {_EVENTS} SELECT t AS eventid, t::DOUBLE AS time, lat::DOUBLE AS lat, lon::DOUBLE AS lon, depth::DOUBLE AS depth, CASE WHEN has THEN round(mb, 1) END AS mb, round(mb + 1, 1) AS ml FROM e")
def s08(spark, sf):
    line = F.concat(F.lit("NEIC, CAT, "), F.date_format("at", "yyyy/MM/dd HH:mm:ss.SSSS"), F.format_string(", %d.0, %d.0, %d.0, 1, 2", "lat", "lon", "depth"), F.when(F.col("has"), F.format_string(", mb, 9.9, mb, %.1f", "mb")).otherwise(""), F.format_string(", ML, %.1f", F.col("mb") + 1))
    path = _texts(_events(spark, sf).select(line), spark, "weed")
    return io.read_weed_bulletin(spark, path).select("eventid", "time", "lat", "lon", "depth", "mb", "ml")


@query("s09_phase_bulletin", f"WITH {_EVENTS} SELECT event_id AS eventid, t + 0.25 AS time, lat::DOUBLE AS lat, lon::DOUBLE AS lon, round(mb, 1) AS mb FROM e WHERE t >= 1704300000")
def s09(spark, sf):
    line = F.concat(F.lit("#  "), F.date_format("at", "yyyy M d H m s"), F.format_string(".25 %d.0 %d.0 %d.0 %.1f 0.1 0.2 0.3 %d", "lat", "lon", "depth", "mb", "event_id"), F.lit("\nABC 3.2 1.0 P"))
    path = _texts(_events(spark, sf).select(line), spark, "phases")
    return io.read_phase_bulletin(spark, path, start=1704300000.0).select("eventid", "time", "lat", "lon", "mb")


@query("s22_traces", "SELECT event_type AS chain, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def s22(spark, sf):
    path = shared_path(spark, "traces")
    e = v.table(spark, sf, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("step"), "value")
    for part in (e.where("step % 2 = 0"), e.where("step % 2 = 1")):  # as a sampler's state is dumped time after time
        io.append_trace(part, path)
    return io.read_traces(spark, path, e.schema).groupBy("chain").agg(F.count("*").alias("n"), F.max("step").alias("last"))


@query("u08_appended", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def u08(spark, sf):
    path = shared_path(spark, "appended")
    v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).write.parquet(path)
    io.appended(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), path)
    return spark.read.parquet(path)


@query("s18_returned_ids", "WITH n AS (SELECT max(s_suppkey) AS last FROM supplier), c AS (SELECT last + row_number() OVER (ORDER BY c_custkey) AS k, c_name AS name FROM customer, n) SELECT k, name, true AS kept FROM c")
def s18(spark, sf):
    path = shared_path(spark, "returning")
    v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).write.parquet(path)
    got = io.inserted(v.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")), path, "k", ["c_custkey"])
    there = spark.read.parquet(path).select("k", F.col("name").alias("_name"))
    return got.join(there, "k", "left").select("k", "name", F.coalesce(F.col("_name") == F.col("name"), F.lit(False)).alias("kept"))
