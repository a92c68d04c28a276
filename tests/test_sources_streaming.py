"""Readers, writers and streams."""

import gzip

from pyspark.sql import functions as F

from tremorlake.sources import bulletins as b
from tremorlake.streaming import detections as st

BULLETIN = """Event 123 TONGA
   Date       Time       Latitude Longitude Depth Ndef Author
2009/04/01 10:20:30.50  -20.5  -175.25  33.0f 12 ISC
2009/04/01 10:20:31.00  -20.4  -175.20  35.0 NEIC
Magnitude  Err Nsta Author
mb 5.1 0.1 20 ISC

Event 124
   Date       Time       Latitude Longitude Depth Ndef Author
2009/04/02 00:00:00.00   10.0   20.0  10.0 5 ISC
"""


def test_bulletin_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(BULLETIN)
    rows = b.read_ims_bulletins(spark, str(tmp_path / "a.txt")).orderBy("eventid", "author").collect()
    assert [(r.eventid, r.author, r.depth, r.ndef, r.mb) for r in rows] == [(123, "ISC", 33.0, 12, 5.1), (123, "NEIC", 35.0, None, None), (124, "ISC", 10.0, 5, None)]
    assert rows[0].time == 1238581230.5 and rows[0].region == "TONGA" and rows[2].region is None


def test_delimited_bulletins(spark, tmp_path):
    (tmp_path / "w.txt").write_text("NEIC, PDE, 2009/04/01 10:20:30.5000, -20.5, -175.2, 33, 1, 2, mb, 5.1, ML, 4.9, mb, 5.3\nshort, line\n")
    row = b.read_weed_bulletin(spark, str(tmp_path / "w.txt")).collect()
    assert [(r.eventid, r.mb, r.ml, r.lat) for r in row] == [(1238581230, 5.3, 4.9, -20.5)]
    (tmp_path / "p.txt").write_text("# 2009 4 1 10 20 30.5 -20.5 -175.2 33 5.1 0 0 0 99\nSTA 1.0 1 P\n")
    row = b.read_phase_bulletin(spark, str(tmp_path / "p.txt")).collect()
    assert [(r.eventid, r.time, r.depth) for r in row] == [(99, 1238581230.5, 33.0)]


def test_tables_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "P"), (1, 2, ""), (2, 3, "S")], "runid long, arid long, phase string")
    b.export_table(df, f"{tmp_path}/t", "arid > 1", ["arid"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == 2
    b.save_run(df, f"{tmp_path}/r", 1)
    got = b.load_run(spark, f"{tmp_path}/r", "runid long, arid long, phase string", df).orderBy("arid").collect()
    assert [(r.runid, r.arid, r.phase) for r in got] == [(3, 1, "P"), (3, 2, None)]
    assert b.export_catalogue({"a": df, "b": df.where("arid = 3")}, f"{tmp_path}/c") == {"a": 3, "b": 1}
    assert b.export_keys(df, {"phase": df.where("arid = 3")}, f"{tmp_path}/k").count() == 1
    (tmp_path / "load.csv").write_text('id, name\n1, "a, b"\n2, c\n')
    assert [tuple(r) for r in b.read_table(spark, str(tmp_path / "load.csv"), "id int, name string").collect()] == [(1, "a, b"), (2, "c")]
    assert b.without(df, df.where("arid = 1"), "arid").count() == 2
    assert {r.phase for r in b.updated(df, df.where("arid = 1").select("arid", F.lit("X").alias("phase")), "arid").collect()} == {"X", "", "S"}


def test_binary_waveforms(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.w").write_bytes(b"\0\0\0\7" + (5).to_bytes(4, "big") + (-2).to_bytes(4, "big", signed=True))
    (tmp_path / "w" / "b.w.gz").write_bytes(gzip.compress((-1 & 0xFFFFFF).to_bytes(3, "big")))
    index = spark.createDataFrame([(1, "a.w", 4, 2, "s4", 0.5), (2, "b.w", 0, 1, "s3", 1.0)], "wfid long, dfile string, foff int, nsamp int, datatype string, calib double")
    got = {r.wfid: r.samples for r in b.read_waveforms(spark, index, str(tmp_path / "w")).collect()}
    assert got == {1: [2.5, -1.0], 2: [-1.0]}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 3, 1_700_000_000 + i * 37 + (i % 7) * 400, float(i * 31 % 17)) for i in range(120)] + [(9, 1_700_100_000, 1.0)]
    df = spark.createDataFrame(rows, "sta long, s long, score double").select("sta", F.timestamp_seconds("s").alias("ts"), "score")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(make, name):
        q = make(st.read_detections(spark, f"{tmp_path}/in", df.schema)).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(map(tuple, spark.table(name).where("sta <> 9").collect()))

    want = df.where("sta <> 9").groupBy(F.window("ts", "1 hour"), "sta").count().select("sta", "window.start", "count").collect()
    assert run(st.uptime, "uptime") == sorted(map(tuple, want))
    want = df.where("sta <> 9").groupBy(F.session_window("ts", "60 seconds"), "sta").count().select("sta", "session_window.start", "session_window.end", "count").collect()
    assert run(lambda d: st.blocks(d, "60 seconds"), "blocks") == sorted(map(tuple, want))
    got = run(lambda d: st.suppressed(d, 50.0), "suppressed")
    assert sum(r[3] for r in got) == 120
