"""Waveform archives: what is written is read back, and conditions leave files, segments and bytes unread."""

import os

import numpy as np
import pytest

from tremorlake.sources import waveforms as w

SEGMENTS = [(f"S{k // 6}", "BHZ" if k % 2 else "BHN", 1000.0 * k + 0.5, 10.0 if k % 4 else 40.0, ("s4", "s3", "i4", "t4", "f4")[k % 5], 0.5, [float((k * 31 + i) % 201 - 100) / 2 for i in range(40 + k)]) for k in range(30)]
SCHEMA = "sta string, chan string, time double, samprate double, datatype string, calib double, samples array<double>"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "a")
    w.write_archive(spark.createDataFrame(SEGMENTS, SCHEMA), path, files=5)
    return path


def test_round_trip(spark, archive):
    got = {(r.sta, r.chan, r.time): (r.endtime, r.samprate, r.samples) for r in w.scan(spark, archive).collect()}
    assert got == {(s[0], s[1], s[2]): (s[2] + len(s[6]) / s[3], s[3], s[6]) for s in SEGMENTS}
    assert len(os.listdir(f"{archive}/samples")) == 5


def test_conditions_choose_chunks(spark, archive):
    every = w.scan(spark, archive, chunk=7).collect()
    want = [r for r in every if r.sta in ("S1", "S3") and r.chan == "BHZ" and r.endtime > 9001.2 and r.time < 21003.0]
    assert 0 < len(want) < len(every)
    assert sorted(w.scan(spark, archive, ["S1", "S3"], ["BHZ"], 9001.2, 21003.0, chunk=7).collect()) == sorted(want)
    assert sorted(w.scan(spark, archive, chan=["BHN"], before=1e6, chunk=7).collect()) == sorted(r for r in every if r.chan == "BHN")
    assert not w.scan(spark, archive, ["none"]).collect() and not w.scan(spark, archive, after=1e6).collect()


def reader(path, **options):
    return w.WaveformSource({"path": path, **options}).reader(None)


def test_files_and_bytes_left_unread(archive):
    everything = reader(archive)
    some = reader(archive, sta='["S4"]')
    assert len(everything.index_files()) == 5 and len(some.index_files()) < 3
    assert len(reader(archive, before="400").index_files()) == 1
    assert not reader(archive, chan='["none"]').index_files()
    narrow = reader(archive, after="29004.0", before="29004.5", chunk="5")
    ranges = [x for part, _ in narrow.index_files() for x in narrow.ranges(part)]
    assert [(s["time"], first, n) for s, first, n, _ in ranges] == [(29000.5, 35, 5)]  # one chunk of the last segment
    assert len(reader(archive, taskBytes="1").partitions()) == 5 and len(everything.partitions()) == 1


def test_fetch_stitches_pads_and_mirrors(spark, tmp_path):
    rows = [("A", "BHZ", 0.0, 1.0, "s4", 1.0, [1.0, 2.0, 3.0, 4.0]), ("A", "EHZ", 6.0, 1.0, "s4", 1.0, [7.0, 8.0, 9.0, 10.0]), ("A", "BHZ", 8.0, 1.0, "s4", 1.0, [50.0, 50.0, 50.0, 12.0, 13.0]), ("B", "BHZ", 0.0, 1.0, "s4", 1.0, [5.0])]
    w.write_archive(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a", files=2)
    requests = spark.createDataFrame([(1, "A", "BHZ", 1.0, 12.0), (2, "A", "SHZ", 2.0, 4.0), (3, "C", "BHZ", 0.0, 9.0), (4, "A", "BHN", 0.0, 9.0), (5, "B", "BHZ", 0.0, 3.0)], "rid int, sta string, chan string, stime double, etime double")
    got = {r.rid: r for r in w.fetch(requests, f"{tmp_path}/a", pad=1.0).collect()}
    # earlier segments keep their samples; of the gap of two one sample comes from each side
    assert got[1].samples == [None, 2.0, 3.0, 4.0, 4.0, 7.0, 7.0, 8.0, 9.0, 10.0, 50.0, 12.0, None]
    assert (got[1].stime, got[1].srate) == (0.0, 1.0)
    assert got[2].samples == [None, 3.0, 4.0, None]
    assert sorted(got) == [1, 2, 5]
    assert w.fetch_one(spark, f"{tmp_path}/a", "A", "SHZ", 1.0, 12.0, 1.0).first().samples == got[1].samples
    mixed = spark.createDataFrame([("A", "BHZ", 13.0, 2.0, "s4", 1.0, [1.0] * 9)], SCHEMA)
    w.write_archive(spark.createDataFrame(rows, SCHEMA).unionByName(mixed), f"{tmp_path}/b", files=2)
    with pytest.raises(Exception, match="several rates"):
        w.fetch(spark.createDataFrame([(1, "A", "BHZ", 1.0, 20.0)], requests.schema), f"{tmp_path}/b").collect()


def test_gzipped_and_absolute_files(spark, tmp_path):
    import gzip

    raw = b"head" + w.encode([5.0, -6.0, 7.0], "s3")
    with gzip.open(f"{tmp_path}/x.gz", "wb") as f:
        f.write(raw)
    rows = spark.createDataFrame([(1, "x", 7, 2, "s3", 2.0), (2, f"{tmp_path}/x", 4, 3, "s3", 1.0)], "rid int, dfile string, at long, n long, datatype string, calib double")
    assert {r.rid: r.samples for r in w.read_ranges(rows, str(tmp_path)).collect()} == {1: [-12.0, 14.0], 2: [5.0, -6.0, 7.0]}


def test_sac_layout(spark, tmp_path):
    wave = [float(x) for x in np.sin(np.arange(64) / 9)]
    files = [("d/1.X.SAC", "A", "BHZ", 100.123, 20.0, wave), ("d/2.HR.SAC", "A", "BHZ", 100.0, 40.0, wave), ("d/3.X.SAC", "A", "SHZ", 103.323, 10.0, wave), ("d/4.SLOW.SAC", "A", "BHZ", 100.0, 5.0, wave), ("e/5.10.SAC", "B", "BHZ", 100.0, 10.0, wave), ("e/6.X.SAC", "B", "BHZ", 106.4, 10.0, wave)]
    w.write_sac(spark.createDataFrame(files, "dfile string, sta string, chan string, time double, samprate double, samples array<double>"), str(tmp_path / "sac"))
    (tmp_path / "sac" / "readme.txt").write_text("none")
    index = w.sac_index(spark, str(tmp_path / "sac"))
    assert sorted((r.sta, r.chan, round(r.time, 3), r.samprate, r.nsamp) for r in index.collect()) == sorted((f[1], f[2], f[3], f[4], 64) for f in files)
    requests = spark.createDataFrame([(1, "A", "BHZ", 100.123, 109.7), (2, "B", "BHZ", 100.0, 112.0)], "rid int, sta string, chan string, stime double, etime double")
    got = {r.rid: r for r in w.fetch(requests, str(tmp_path / "sac"), 0.0, "sac", index, mirror=False).collect()}
    assert got[1].srate == 10.0 and len(got[1].samples) == 95
    assert np.allclose(got[1].samples[32:], np.float32(wave[:63]), atol=1e-6)  # the slower file as it is
    assert np.abs(np.array(got[1].samples[4:28]) - wave[8:56:2]).max() < 0.05  # the faster one at half its rate
    assert [x is None for x in got[2].samples] == [False] * 64 + [True] * 56  # a file named .10. shuts others out
    big = bytearray(w.sac_header("Q", "BHN", 5.25, 50.0, 3))
    swapped = np.frombuffer(bytes(big[:440]), "<u4").astype(">u4").tobytes() + bytes(big[440:])
    assert w.parse_sac_header(swapped) | {"datatype": 0} == w.parse_sac_header(bytes(big)) | {"datatype": 0}
    assert w.parse_sac_header(swapped)["datatype"] == "t4"
