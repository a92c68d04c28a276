"""The catalogue's tables as views of the star-schema test tables, as DataFrames and as SQL with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.time import epoch

#: An origin for each order, a detection for each event, an association for each line item, a site for each supplier.
SQL = {
    "origin": "SELECT o_orderkey AS orid, epoch(o_orderdate) AS time, (o_orderkey * 37 % 360 - 180.0)::DOUBLE AS lon, (o_orderkey * 17 % 181 - 90.0)::DOUBLE AS lat, (o_custkey % 700)::DOUBLE AS depth, 2 + o_totalprice / 100000 AS mb FROM orders",
    "arrival": "SELECT event_id AS arid, user_id AS sta, event_type AS iphase, epoch(ts) AS time, value AS amp, value - 5 AS snr, (event_id * 7 % 360)::DOUBLE AS azimuth, (event_id % 40)::DOUBLE AS slow, (event_id % 11 - 1)::DOUBLE AS delaz, (event_id % 13 - 1)::DOUBLE AS delslo FROM events",
    "site": "SELECT s_suppkey AS sta, (s_suppkey * 37 % 360 - 180.0)::DOUBLE AS lon, (s_suppkey * 17 % 181 - 90.0)::DOUBLE AS lat, s_acctbal AS elev, CASE WHEN s_suppkey % 3 = 0 THEN 'ar' ELSE 'ss' END AS statype, s_suppkey // 10 * 10 AS refsta, CASE WHEN s_suppkey % 7 = 0 THEN 2024010 ELSE 2023001 END AS ondate, CASE WHEN s_suppkey % 5 = 0 THEN 2024020 ELSE -1 END AS offdate FROM supplier",
    "phase": "SELECT * FROM (VALUES (1, 'click', 'd'), (2, 'view', 'd'), (3, 'purchase', 'd'), (4, 'error', 'n')) AS t(id, phase, timedef)",
    "assoc": "SELECT l_orderkey AS orid, l_partkey * 5 + l_linenumber AS arid, l_returnflag AS phase, CASE WHEN l_linestatus = 'F' THEN 'd' ELSE 'n' END AS timedef, l_discount AS timeres, l_quantity AS delta FROM lineitem",
    "gold": "SELECT event_id AS id, epoch(ts) AS t, (event_id * 37 % 360 - 180.0)::DOUBLE AS lon, (event_id * 17 % 161 - 80.0)::DOUBLE AS lat, 3 + value / 200 AS mb FROM events WHERE event_id % 3 = 0",
    "guess": "SELECT event_id AS id, epoch(ts) + (event_id % 81 - 40) AS t, (event_id * 37 % 360 - 180 + (event_id % 5 - 2) * 0.25)::DOUBLE AS lon, (event_id * 17 % 161 - 80.0)::DOUBLE AS lat, (event_id * 7919 % 1000 / 1000.0)::DOUBLE AS score FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0 UNION ALL SELECT event_id, epoch(ts), (event_id * 37 % 360 - 180.0)::DOUBLE, (event_id * 17 % 161 - 80.0)::DOUBLE, (event_id * 7919 % 1000 / 1000.0)::DOUBLE FROM events WHERE event_id % 9 = 1",
}


def with_views(*names: str) -> str:
    """A WITH clause for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _angle(key: str, by: int, period: int, shift: float):
    return (F.col(key) * by % period - F.lit(shift)).cast("double")


def origin(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("orid"), epoch("o_orderdate").alias("time"), _angle("o_orderkey", 37, 360, 180.0).alias("lon"), _angle("o_orderkey", 17, 181, 90.0).alias("lat"), (F.col("o_custkey") % 700).cast("double").alias("depth"), (2 + F.col("o_totalprice") / 100000).alias("mb"))


def arrival(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("arid"), F.col("user_id").alias("sta"), F.col("event_type").alias("iphase"), epoch("ts").alias("time"), F.col("value").alias("amp"), (F.col("value") - 5).alias("snr"), (e * 7 % 360).cast("double").alias("azimuth"), (e % 40).cast("double").alias("slow"), (e % 11 - 1).cast("double").alias("delaz"), (e % 13 - 1).cast("double").alias("delslo"))


def site(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("sta"), _angle("s_suppkey", 37, 360, 180.0).alias("lon"), _angle("s_suppkey", 17, 181, 90.0).alias("lat"), F.col("s_acctbal").alias("elev"), F.when(s % 3 == 0, "ar").otherwise("ss").alias("statype"), (F.floor(s / 10) * 10).alias("refsta"), F.when(s % 7 == 0, 2024010).otherwise(2023001).alias("ondate"), F.when(s % 5 == 0, 2024020).otherwise(-1).alias("offdate"))


def phase(spark, sf=None) -> DataFrame:
    return spark.createDataFrame([(1, "click", "d"), (2, "view", "d"), (3, "purchase", "d"), (4, "error", "n")], "id int, phase string, timedef string")


def assoc(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orid"), (F.col("l_partkey") * 5 + F.col("l_linenumber")).alias("arid"), F.col("l_returnflag").alias("phase"), F.when(F.col("l_linestatus") == "F", "d").otherwise("n").alias("timedef"), F.col("l_discount").alias("timeres"), F.col("l_quantity").alias("delta"))


def gold(spark, sf) -> DataFrame:
    return table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("id"), epoch("ts").alias("t"), _angle("event_id", 37, 360, 180.0).alias("lon"), _angle("event_id", 17, 161, 80.0).alias("lat"), (3 + F.col("value") / 200).alias("mb"))


def guess(spark, sf) -> DataFrame:
    e = F.col("event_id")
    score = (e * 7919 % 1000 / 1000.0).cast("double").alias("score")
    near = table(spark, sf, "events").where("event_id % 3 = 0 AND event_id % 7 <> 0").select(e.alias("id"), (epoch("ts") + (e % 81 - 40)).alias("t"), (e * 37 % 360 - 180 + (e % 5 - 2) * 0.25).cast("double").alias("lon"), _angle("event_id", 17, 161, 80.0).alias("lat"), score)
    false = table(spark, sf, "events").where("event_id % 9 = 1").select(e.alias("id"), epoch("ts").alias("t"), _angle("event_id", 37, 360, 180.0).alias("lon"), _angle("event_id", 17, 161, 80.0).alias("lat"), score)
    return near.unionByName(false)
