"""Blocks of a period, and numbers given to inserted rows."""

import math

from pyspark.sql import functions as F

from tremorlake.functions import blocks
from tremorlake.operators.lineage import shared_path
from tremorlake.sources import bulletins
from tremorlake.streaming import detections as streams


def test_fixed_blocks_stretch_the_last(spark):
    times = [99.9, 100.0, 109.9, 110.0, 129.9, 130.0, 134.9, 135.0, None]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    got = [tuple(r.b) if r.b else None for r in df.select("t", blocks.fixed_block("t", 100, 135, 10).alias("b")).collect()]
    assert got == [None, (0, 100, 110), (0, 100, 110), (1, 110, 120), (2, 120, 135), (2, 120, 135), (2, 120, 135), None, None]
    short = df.select(blocks.fixed_block("t", 100, 104, 10).alias("b")).where("b IS NOT NULL").distinct().collect()
    assert [tuple(r.b) for r in short] == [(0, 100, 104)]  # a period shorter than a block is one
    counted = {r.block: r.n for r in streams.in_blocks(df, blocks.fixed_block("t", 100, 135, 10)).collect()}
    assert counted == {0: 2, 1: 1, 2: 3}


def test_equal_blocks_cover_the_period(spark):
    first, last = 0.1, 100.3
    n = math.ceil((last - first) / 7)
    length = (last - first) / n
    edges = [first + k * length for k in range(n)] + [last]
    times = [t for e in edges for t in (math.nextafter(e, -1), e, math.nextafter(e, 1e9))]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    for r in df.select("t", blocks.equal_block("t", first, last, 7).alias("b")).collect():
        want = [k for k in range(n) if edges[k] <= r.t < edges[k + 1]]
        assert ([r.b.block] if r.b else []) == want
        assert not r.b or (r.b.stime, r.b.etime) == (edges[want[0]], edges[want[0] + 1])


def test_inserted_rows_return_their_numbers(spark):
    path = shared_path(spark, "table")
    spark.createDataFrame([(7, "old"), (3, "older")], "k long, name string").write.parquet(path)
    new = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1), (None, 3)], "name string, other int").repartition(3)
    got = sorted((r.other, r.k, r.name) for r in bulletins.inserted(new, path, "k", ["other"]).collect())
    assert [k for _, k, _ in got] == [8, 9, 10, 11] and [n for *_, n in got] == ["a", "a", "b", None]
    table = {r.k: r.name for r in spark.read.parquet(path).collect()}
    assert table == {7: "old", 3: "older", 8: "a", 9: "a", 10: "b", 11: None}
    assert not bulletins.inserted(new.where("false"), path, "k", ["other"]).collect()
    empty = shared_path(spark, "empty")
    spark.range(0).select(F.col("id").alias("k"), F.lit("x").alias("name")).write.parquet(empty)
    assert sorted(r.k for r in bulletins.inserted(new, empty, "k", ["other"]).collect()) == [1, 2, 3, 4]
