"""Bulletins read by splits: events over the borders of splits, lines before the first event, several files."""

from tremorlake.sources import bulletins as b


def _text(first, n):
    out = ["BEGIN IMS", "mb 9.9 0.1 1 REB"]
    for k in range(first, first + n):
        out += [f"{'  EVENT' if k % 5 == 0 else 'Event'} {k} PLACE {k}" if k % 7 else f"Event {k}", "   Date       Time        Err   RMS Latitude Longitude  Depth   Ndef Author", f"2009/04/01 10:20:{k % 60:02d}.50  -20.5  {k % 90}.25  33.0f 12 ISC"]
        out += ["Magnitude  Err Nsta Author", f"mb {k % 50 / 10} 0.1 20 ISC"] * (k % 3 > 0) + ["Sta     Dist  EvAz"] + ["ABC 12.1 33.0"] * (k % 4)
    return "\n".join(out) + "\n"


def test_splits_give_what_whole_files_give(spark, tmp_path):
    texts = [_text(1, 60), _text(1000, 45), "no event at all\n", ""]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text(t)
    want = sorted((tuple(r.values()) for t in texts for r in b.parse_ims_bulletin(t)), key=str)
    assert len(want) == 105
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (150, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            if size == 1000:
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4  # files are cut
            assert sorted((tuple(r) for r in b.read_ims_bulletins(spark, str(tmp_path)).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_file_is_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text(_text(1, 5))
    plan = b.read_ims_bulletins(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower() and "MapIn" not in plan  # parsed split by split before
