"""Waveform archives: sample files, an index of segments, and a data source that reads only the bytes a query needs.

An archive is a folder:

    samples/    binary files; each holds the samples of the segments that one task wrote, one after the other
    index/      Parquet rows (sta, chan, time, endtime, samprate, nsamp, datatype, calib, dfile, foff), one file for each sample file
    manifest/   one row for each index file: how many bytes of samples it names, and the range of stations, channels and times there

Segments are range-partitioned by (sta, chan, time) before they are written, so an index file covers a narrow range. A file of another archive
(SAC, a header before the samples) fits the same index, foff being what precedes the samples.

``scan`` reads the format "waveforms". A row is a chunk of a segment: stations, channels and a time span choose index files by the manifest,
segments by the index, and chunks by their places; neighbouring chunks are one read of a byte range. They are options, not filters that Spark pushes down: in Spark 4.1
a relation keeps what was pushed into it, so a table that is filtered twice in different ways would give the first filter's rows again.
"""

from __future__ import annotations

import json
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of samples that a task of the source reads, about.
TASK_BYTES = 64 << 20
#: Samples of a row of the source.
CHUNK = 1 << 16
INDEX = "sta string, chan string, time double, endtime double, samprate double, nsamp long, datatype string, calib double, dfile string, foff long"
#: Sample formats, as numpy names them; s3 is a big-endian integer of three bytes.
FORMATS = {"s4": ">i4", "s3": "s3", "i4": "<i4", "t4": ">f4", "f4": "<f4"}


def _open(name: str):
    """A seekable file of any file system that Arrow knows; a gzipped one may stand for it."""
    import io

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return io.BytesIO(system.open_input_stream(path + ".gz", compression="gzip").read())
    return system.open_input_file(path)


def _create(name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def sample_bytes(datatype: str) -> int:
    return int(datatype[1])


def encode(samples, datatype: str) -> bytes:
    import numpy as np

    if datatype != "s3":
        kind = np.dtype(FORMATS[datatype])
        return (np.rint(samples) if kind.kind == "i" else np.asarray(samples)).astype(kind).tobytes()
    return np.rint(samples).astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def decode(raw: bytes, datatype: str, calib: float):
    import numpy as np

    if datatype != "s3":
        return np.frombuffer(raw, FORMATS[datatype]).astype(float) * calib
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    value = b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]
    return np.where(value >= 1 << 23, value - (1 << 24), value) * calib


def write_archive(segments: DataFrame, path: str, files: int | None = None) -> None:
    """Writes (sta, chan, time, samprate, datatype, calib, samples) as an archive. Only what a committed task wrote is in the index; sample files of lost ones are
    never named."""
    spark = segments.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.select(F.col("sta").cast("string").alias("sta"), "chan", F.col("time").cast("double").alias("time"), F.col("samprate").cast("double").alias("samprate"), "datatype", F.col("calib").cast("double").alias("calib"), F.col("samples").cast("array<double>").alias("samples"))
    dealt = rows.repartitionByRange(n, "sta", "chan", "time").sortWithinPartitions("sta", "chan", "time")

    def write(batches):
        import pyarrow as pa

        name, at, file = f"samples/{uuid.uuid4().hex}", 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = encode([x / row["calib"] for x in row.pop("samples")], row["datatype"])
                file = file or _create(f"{path}/{name}")
                file.write(raw)
                k = len(raw) // sample_bytes(row["datatype"])
                out.append(row | {"endtime": row["time"] + k / row["samprate"], "nsamp": k, "dfile": name, "foff": at})
                at += len(raw)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file:
            file.close()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], INDEX).schema)
    dealt.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    write_manifest(spark, path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """A row for each index file with the ranges it covers."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    ranges = [f(c).alias(f"{name}_{c}") for c in ("sta", "chan", "time", "endtime") for name, f in (("low", F.min), ("high", F.max))]
    index.groupBy("part").agg(F.sum(F.col("nsamp") * F.substring("datatype", 2, 1).cast("long")).alias("n_bytes"), *ranges).write.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.task_bytes = options["path"], int(options.get("chunk", CHUNK)), int(options.get("taskBytes", TASK_BYTES))
        self.names = {c: json.loads(options[c]) for c in ("sta", "chan") if c in options}
        self.after, self.before = float(options.get("after", "-inf")), float(options.get("before", "inf"))

    def index_files(self) -> list[tuple[str, int]]:
        """Index files that may have chosen rows, by the manifest, with the bytes of samples that they name."""
        out = []
        for r in _dataset(f"{self.path}/manifest").to_table().to_pylist():
            named = all(any(r[f"low_{c}"] <= v <= r[f"high_{c}"] for v in values) for c, values in self.names.items())
            if named and r["low_time"] < self.before and r["high_endtime"] > self.after:
                out.append(((r["low_sta"], r["low_chan"], r["low_time"]), r["part"], r["n_bytes"]))
        return [(part, n) for _, part, n in sorted(out)]

    def partitions(self):
        groups, size = [[]], 0
        for part, n in self.index_files():
            if groups[-1] and size + n > self.task_bytes:
                groups.append([])
                size = 0
            groups[-1].append(part)
            size += n
        return [InputPartition(tuple(g)) for g in groups]

    def ranges(self, part: str):
        """(segment, first sample, samples, times of the chunks there) to be read of an index file's segments."""
        import numpy as np
        import pyarrow.dataset as ds

        condition = (ds.field("time") < self.before) & (ds.field("endtime") > self.after)
        for c, values in self.names.items():
            condition &= ds.field(c).isin(values)
        for s in _dataset(f"{self.path}/index/{part}").to_table(filter=condition).to_pylist():
            first = np.arange(0, s["nsamp"], self.chunk)
            last = np.minimum(first + self.chunk, s["nsamp"])
            begin, end = s["time"] + first / s["samprate"], s["time"] + last / s["samprate"]
            keep = (begin < self.before) & (end > self.after)
            at = np.flatnonzero(keep)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                a, z = run[0], run[-1]
                yield s, int(first[a]), int(last[z] - first[a]), [(float(begin[k]), float(end[k]), int(first[k] - first[a]), int(last[k] - first[a])) for k in run]

    def read(self, partition):
        import pyarrow as pa

        file, name = None, None
        for part in partition.value:
            for s, first, n, chunks in self.ranges(part):
                if s["dfile"] != name:
                    name, file = s["dfile"], _open(_below(self.path, s["dfile"]))
                width = sample_bytes(s["datatype"])
                file.seek(s["foff"] + first * width)
                x = decode(file.read(n * width), s["datatype"], s["calib"])
                for begin, end, a, z in chunks:
                    yield pa.record_batch([pa.array([s["sta"]]), pa.array([s["chan"]]), pa.array([begin]), pa.array([end]), pa.array([s["samprate"]]), pa.array([x[a:z].tolist()], pa.list_(pa.float64()))], ["sta", "chan", "time", "endtime", "samprate", "samples"])


def _below(path: str, dfile: str) -> str:
    return dfile if dfile.startswith("/") or "://" in dfile or dfile.startswith("file:") else f"{path}/{dfile}"


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(inner, filesystem=system, format="parquet")


class WaveformSource(DataSource):
    """Format "waveforms". Options: path of the archive; sta and chan as JSON lists of names; after and before, for chunks that end after the one
    and begin before the other; chunk, the samples of a row; taskBytes, what a task reads."""

    @classmethod
    def name(cls):
        return "waveforms"

    def schema(self):
        return "sta string, chan string, time double, endtime double, samprate double, samples array<double>"

    def reader(self, schema):
        return _Reader(dict(self.options.items()))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The source travels by value, so its planner needs no import path."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WaveformSource)


def scan(spark: SparkSession, path: str, sta: list[str] | None = None, chan: list[str] | None = None, after: float | None = None, before: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """(sta, chan, time, endtime, samprate, samples) of the chunks of these stations and channels that overlap a time span."""
    register(spark)
    given = {"sta": sta and json.dumps(sta), "chan": chan and json.dumps(chan), "after": after, "before": before}
    return spark.read.format("waveforms").options(path=path, chunk=chunk, **{k: x for k, x in given.items() if x is not None}).load()


def stitched_grid(parts: list, begin: float, end: float, rate: float, mirror: bool, pad: float):
    """Samples on a grid from begin: parts (time, rate, samples) in the order of their times, each where nothing was put before; parts of a multiple of the rate are
    decimated. Gaps are NaN, or filled by reflection; pad seconds at both ends are NaN."""
    import numpy as np

    from tremorlake.functions import waves

    grid = np.full(max(0, int(np.floor((end - begin) * rate + 1e-4))), np.nan)
    for time, own, samples in sorted(parts, key=lambda p: (p[0], p[1])):
        at = int(np.floor((time - begin) * rate + 1e-4))
        x, _ = waves.decimate(np.asarray(samples, float), own, rate)
        lo, hi = max(0, -at), min(len(x), len(grid) - at)
        if hi > lo:
            here = grid[at + lo : at + hi]
            grid[at + lo : at + hi] = np.where(np.isnan(here), x[lo:hi], here)
    if mirror:
        grid = waves.mirror_missing(grid)
    edge = min(int(pad * rate), len(grid))
    if edge:
        grid[:edge] = grid[len(grid) - edge :] = np.nan
    return grid


def needed_ranges(requests: DataFrame, index: DataFrame, pad: float, layout: str = "ims", least_rate: float = 9.0) -> DataFrame:
    """(rid, begin, end, time, samprate, datatype, calib, dfile, at, n): the samples of each segment that a request (rid, sta, chan, stime, etime) needs, padding
    included. Channels that stand for one another are one. Layout "sac" leaves out slow segments and those named .HR., and takes those named .10. alone where there are any."""
    from tremorlake.functions import names
    from tremorlake.operators.joins import overlap_join

    asked = requests.select("rid", F.col("sta").cast("string").alias("sta"), names.canonical_channel("chan").alias("chan"), (F.col("stime") - pad).alias("begin"), (F.col("etime") + pad).alias("end"))
    held = index.withColumn("chan", names.canonical_channel("chan")).withColumnRenamed("time", "seg_time")
    both = overlap_join(asked, held, ("begin", "end"), ("seg_time", "endtime"), 3600.0, keys=["sta", "chan"]).where("seg_time < end AND endtime > begin")
    if layout == "sac":
        both = both.where((F.col("samprate") > least_rate) & ~F.col("dfile").contains(".HR."))
        tens = both.where(F.col("dfile").contains(".10.")).select("rid").distinct().withColumn("has_tens", F.lit(True))
        both = both.join(tens, "rid", "left").where(F.col("has_tens").isNull() | F.col("dfile").contains(".10.")).drop("has_tens")
    first = F.greatest(F.lit(0), F.floor((F.col("begin") - F.col("seg_time")) * F.col("samprate") + 1e-4)).cast("long")
    stop = F.least("nsamp", F.ceil((F.col("end") - F.col("seg_time")) * F.col("samprate") - 1e-4)).cast("long")
    width = F.substring("datatype", 2, 1).cast("long")
    out = both.withColumns({"first": first, "stop": stop}).where("stop > first")
    return out.select("rid", "begin", "end", (F.col("seg_time") + F.col("first") / F.col("samprate")).alias("time"), "samprate", "datatype", "calib", "dfile", (F.col("foff") + F.col("first") * width).alias("at"), (F.col("stop") - F.col("first")).alias("n"))


def read_ranges(ranges: DataFrame, path: str) -> DataFrame:
    """Adds samples: the n samples at byte ``at`` of each row's file. Rows go to tasks by file and place, so that a file that many ask for is shared out."""

    def read(batches):
        import pyarrow as pa

        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["dfile"] != name:
                    name, file = row["dfile"], _open(_below(path, row["dfile"]))
                file.seek(row["at"])
                out.append(decode(file.read(row["n"] * sample_bytes(row["datatype"])), row["datatype"], row["calib"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "samples"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*ranges.schema.fields, StructField("samples", ArrayType(DoubleType()))])
    return ranges.repartitionByRange("dfile", "at").sortWithinPartitions("dfile", "at").mapInArrow(read, schema)


def fetch(requests: DataFrame, path: str, pad: float = 20.0, layout: str = "ims", index: DataFrame | None = None, mirror: bool = True) -> DataFrame:
    """(rid, stime, srate, samples) of each request that any segment overlaps: one waveform on a grid, gaps mirrored if asked for, padding null. stime is that of the first
    sample, padding included. In the layout "ims" all segments have one rate, anything else is an error; in "sac" the least rate is taken and faster ones are decimated."""
    ranges = needed_ranges(requests, index if index is not None else read_index(requests.sparkSession, path), pad, layout)
    rid = ranges.schema["rid"].dataType.simpleString()

    def stitch(part):
        import numpy as np
        import pandas as pd

        rate = float(part["samprate"].min())
        if layout == "ims" and part["samprate"].nunique() > 1:
            raise ValueError("segments of several rates")
        r = part.iloc[0]
        grid = stitched_grid(list(zip(part["time"], part["samprate"], part["samples"])), r["begin"], r["end"], rate, mirror, pad)
        return pd.DataFrame({"rid": [r["rid"]], "stime": [r["begin"]], "srate": [rate], "samples": [[None if np.isnan(x) else float(x) for x in grid]]})

    return read_ranges(ranges, path).groupBy("rid").applyInPandas(stitch, f"rid {rid}, stime double, srate double, samples array<double>")


def fetch_one(spark: SparkSession, path: str, sta: str, chan: str, stime: float, etime: float, pad: float = 20.0) -> DataFrame:
    """One waveform through the data source: the conditions choose index files, segments and byte ranges."""
    from tremorlake.functions import names

    begin, end = stime - pad, etime + pad
    rows = scan(spark, path, [sta], list(names.VERTICAL) if chan in names.VERTICAL else [chan], begin, end)

    def stitch(part):
        import numpy as np
        import pandas as pd

        rate = float(part["samprate"].iloc[0])
        grid = stitched_grid(list(zip(part["time"], part["samprate"], part["samples"])), begin, end, rate, True, pad)
        return pd.DataFrame({"sta": [sta], "stime": [begin], "srate": [rate], "samples": [[None if np.isnan(x) else float(x) for x in grid]]})

    return rows.groupBy("sta").applyInPandas(stitch, "sta string, stime double, srate double, samples array<double>")


#: Fixed values of the SAC format: bytes of a header, byte offsets of its floats, integers and texts, and what stands for a missing number.
SAC_HEADER, SAC_MISSING = 632, -12345
SAC_FLOATS = {"delta": 0, "b": 20, "e": 24, "stla": 124, "stlo": 128}
SAC_INTEGERS = {"nzyear": 280, "nzjday": 284, "nzhour": 288, "nzmin": 292, "nzsec": 296, "nzmsec": 300, "nvhdr": 304, "npts": 316}
SAC_TEXTS = {"kstnm": (440, 8), "kcmpnm": (600, 8)}


def sac_header(sta: str, chan: str, time: float, rate: float, n: int) -> bytes:
    """A little-endian header; the time's fraction beyond a millisecond is in b."""
    import struct
    from datetime import datetime, timezone

    head = bytearray(struct.pack("<158i", *[SAC_MISSING] * 158))
    head[:280] = struct.pack("<70f", *[float(SAC_MISSING)] * 70)
    millis = int(time * 1000 // 1)
    t = datetime.fromtimestamp(millis // 1000, timezone.utc)
    for k, x in {"delta": 1 / rate, "b": time - millis / 1000, "e": time - millis / 1000 + (n - 1) / rate}.items():
        struct.pack_into("<f", head, SAC_FLOATS[k], x)
    for k, x in {"nzyear": t.year, "nzjday": t.timetuple().tm_yday, "nzhour": t.hour, "nzmin": t.minute, "nzsec": t.second, "nzmsec": millis % 1000, "nvhdr": 6, "npts": n}.items():
        struct.pack_into("<i", head, SAC_INTEGERS[k], x)
    for k, x in {"kstnm": sta, "kcmpnm": chan}.items():
        at, size = SAC_TEXTS[k]
        head[at : at + size] = x.encode()[:size].ljust(size)
    return bytes(head)


def parse_sac_header(head: bytes) -> dict | None:
    """Station, channel, times, rate, length and byte order of a header; None for anything else."""
    import struct
    from datetime import datetime, timezone

    order = next((o for o in "<>" if len(head) >= SAC_HEADER and struct.unpack_from(o + "i", head, SAC_INTEGERS["nvhdr"])[0] in (6, 7)), None)
    if order is None:
        return None
    f = {k: struct.unpack_from(order + "f", head, at)[0] for k, at in SAC_FLOATS.items()}
    n = {k: struct.unpack_from(order + "i", head, at)[0] for k, at in SAC_INTEGERS.items()}
    t = {k: head[at : at + size].decode("ascii", "replace").rstrip("\0 ") for k, (at, size) in SAC_TEXTS.items()}
    zero = datetime(n["nzyear"], 1, 1, tzinfo=timezone.utc).timestamp() + ((n["nzjday"] - 1) * 24 + n["nzhour"]) * 3600 + n["nzmin"] * 60 + n["nzsec"] + n["nzmsec"] / 1000
    begin, rate = zero + (0.0 if f["b"] == SAC_MISSING else f["b"]), float(f"{1 / f['delta']:.6g}")  # delta is a 32-bit float
    return {"sta": t["kstnm"], "chan": t["kcmpnm"], "time": begin, "endtime": begin + n["npts"] / rate, "samprate": rate, "nsamp": n["npts"], "datatype": "f4" if order == "<" else "t4", "calib": 1.0}


def write_sac(segments: DataFrame, path: str) -> None:
    """A SAC file for each row (dfile, sta, chan, time, samprate, samples)."""

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with _create(f"{path}/{row['dfile']}") as file:
                    file.write(sac_header(row["sta"], row["chan"], row["time"], row["samprate"], len(row["samples"])) + encode(row["samples"], "f4"))
            yield pa.record_batch([batch.column(0)], ["dfile"])

    segments.select("dfile", F.col("sta").cast("string").alias("sta"), "chan", "time", "samprate", "samples").mapInArrow(write, "dfile string").agg(F.count("*")).collect()


def sac_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the SAC files below a folder: files are listed by Spark, and only their first SAC_HEADER bytes are read. Other files give no row."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with _open(name) as file:
                    head = parse_sac_header(file.read(SAC_HEADER))
                if head:
                    rows.append(head | {"dfile": name, "foff": SAC_HEADER})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], INDEX).schema)
    return listed.mapInArrow(read, INDEX)
