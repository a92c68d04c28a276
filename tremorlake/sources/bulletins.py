"""Readers and writers of catalogues: delimited tables, bulletins as text, binary waveforms, runs."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import waves
from tremorlake.operators.lineage import stored


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ", ", header: bool = True) -> DataFrame:
    """Delimited text with optional double quotes and, mostly, a header line in each file."""
    return spark.read.schema(schema).options(sep=sep, quote='"', header=header, ignoreLeadingWhiteSpace=True).csv(path)


def export_table(df: DataFrame, path: str, where: str | None = None, order: list[str] | None = None) -> None:
    out = df.where(where) if where else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).csv(path)


def export_keys(df: DataFrame, keys: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the rows whose columns are all among the given keys (name -> table with that column) and returns them."""
    for name, table in keys.items():
        df = df.join(table.select(name).distinct(), name, "left_semi")
    df.write.mode("overwrite").option("header", True).csv(path)
    return df


def export_catalogue(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes each table below path and returns its row count, which the write itself observes."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def save_run(df: DataFrame, path: str, runid: int) -> None:
    df.where(F.col("runid") == runid).write.mode("overwrite").option("header", True).csv(path)


def load_run(spark: SparkSession, path: str, schema: str, existing: DataFrame) -> DataFrame:
    """A saved run under a new id, one above those there are; blank texts are null."""
    new = existing.agg((F.coalesce(F.max("runid"), F.lit(0)) + 1).alias("n")).first()["n"]
    df = spark.read.schema(schema).option("header", True).csv(path)
    blank = {f.name: F.nullif(F.trim(F.col(f.name)), F.lit("")) for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.withColumns(blank | {"runid": F.lit(new)})


def _number(text: str) -> float | None:
    text = text.strip()
    try:
        return float(text)
    except ValueError:
        return None


def _epoch(*parts) -> float:
    y, mo, d, h, mi, s = parts
    return datetime(int(y), int(mo), int(d), int(h), int(mi), tzinfo=timezone.utc).timestamp() + float(s)


def parse_ims_bulletin(text: str) -> list[dict]:
    """Events of one bulletin text: origin lines (date, time, latitude, longitude, depth, counts, author) and magnitude
    lines below them. An author's mb and ML join its origin; one without magnitude has nulls; depths marked f (fixed)
    count like others."""
    rows, origins, eventid, region, part = [], {}, None, None, ""

    def flush():
        rows.extend(origins.values())
        origins.clear()

    for line in text.splitlines():
        if m := re.match(r"\s*Event\s+(\d+)\s*(.*)", line, re.I):
            flush()
            eventid, region, part = int(m[1]), m[2].strip() or None, ""
        elif re.match(r"\s*Date\s+Time", line):
            part = "origins"
        elif re.match(r"\s*Magnitude\s+", line):
            part = "magnitudes"
        elif re.match(r"\s*Sta\s+Dist", line):
            part = "detections"
        elif part == "origins" and (m := re.match(r"\s*(\d{4})/(\d\d)/(\d\d)\s+(\d\d):(\d\d):(\d\d\.?\d*)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(\S+)\s*(.*?)\s*(\S+)\s*$", line)):
            depth = m[9].rstrip("f")
            counts = [_number(x) for x in m[10].split()]
            origins[m[11]] = {"eventid": eventid, "region": region, "author": m[11], "time": _epoch(*m.groups()[:6]), "lat": float(m[7]), "lon": float(m[8]), "depth": _number(depth), "ndef": int(counts[0]) if counts and counts[0] is not None else None, "mb": None, "ml": None}
        elif part == "magnitudes" and (m := re.match(r"\s*(mb|ml)\S*\s+(-?[\d.]+).*?(\S+)\s*$", line, re.I)) and m[3] in origins:
            origins[m[3]]["mb" if m[1].lower() == "mb" else "ml"] = float(m[2])
    flush()
    return rows


BULLETIN = "eventid long, region string, author string, time double, lat double, lon double, depth double, ndef int, mb double, ml double"


#: Lines of events that are parsed together.
EVENT_LINES = 4096


def read_ims_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """One row per event and author. Files are read by splits of any size, and a task holds a few events' lines at a time: what a split has before its first event, and its last event, may go on in its
    neighbours, so these are put together by file and parsed after that."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names, parts = [x.split()[0] for x in BULLETIN.split(", ")], BULLETIN + ", _file string, _at long, _part int, _text string"
    event, rows_schema, parts_schema = re.compile(r"\s*Event\s+\d+", re.I), to_arrow_schema(StructType.fromDDL(BULLETIN)), to_arrow_schema(StructType.fromDDL(parts))

    def parsed(lines: list[str]):
        return pa.RecordBatch.from_pylist(parse_ims_bulletin("\n".join(lines)), schema=parts_schema)

    def parse(batches):
        split, seen, own, ready = None, False, [], []

        def end():
            # parts of a split: 0 before its first event, 1 its last event
            return pa.RecordBatch.from_pylist([{"_file": split[0], "_at": split[1], "_part": int(seen), "_text": "\n".join(own)}], schema=parts_schema)

        for batch in batches:
            for value, *at in zip(*(c.to_pylist() for c in batch.columns)):
                if at != split:
                    if split:
                        yield end()
                    split, seen, own = at, False, []
                if event.match(value):
                    if seen:
                        ready += own
                    elif own:
                        yield end()
                    seen, own = True, []
                    if len(ready) >= EVENT_LINES:
                        yield parsed(ready)
                        ready = []
                own.append(value)
            if ready:
                yield parsed(ready)
                ready = []
        if split:
            yield end()

    def join(table: pa.Table) -> pa.Table:
        # in a file's order, an event and what later splits have of it before their own first one
        texts = table.sort_by([("_at", "ascending"), ("_part", "ascending")])["_text"].to_pylist()
        return pa.Table.from_pylist(parse_ims_bulletin("\n".join(texts)), schema=rows_schema)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    read = stored(lines.mapInArrow(parse, parts), "bulletins")
    return read.where("_text IS NULL").select(*names).unionByName(read.where("_text IS NOT NULL").groupBy("_file").applyInArrow(join, BULLETIN))


def read_weed_bulletin(spark: SparkSession, path: str) -> DataFrame:
    """Lines "author, catalogue, date time, lat, lon, depth, ..., type, value, type, value": the last mb and the last ml
    count; an event's id is its second. Stays in expressions."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 8)
    time = F.unix_micros(F.try_to_timestamp(F.element_at("p", 3), F.lit("yyyy/MM/dd HH:mm:ss.SSSS"))) / 1e6
    tail = F.slice("p", 9, F.greatest(F.size("p") - 8, F.lit(0)))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(tail) - 2, F.lit(0))), lambda i: i % 2 == 0), lambda i: F.struct(F.lower(F.get(tail, i)).alias("k"), F.get(tail, i + 1).try_cast("double").alias("v")))
    last = lambda kind: F.try_element_at(F.filter(pairs, lambda x: (x.k == kind) & x.v.isNotNull()), F.lit(-1)).v
    return rows.select(F.floor(time).cast("long").alias("eventid"), F.element_at("p", 1).alias("author"), time.alias("time"), F.element_at("p", 4).try_cast("double").alias("lat"), F.element_at("p", 5).try_cast("double").alias("lon"), F.element_at("p", 6).try_cast("double").alias("depth"), last("mb").alias("mb"), last("ml").alias("ml")).where("eventid IS NOT NULL")


def read_phase_bulletin(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Event lines "# year month day hour minute second lat lon depth mag ... id" of 15 to 17 tokens; others are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").startswith("#")).select(t.alias("t")).where(F.size("t").between(15, 17))
    num = lambda i: F.element_at("t", i).try_cast("double")
    time = F.unix_timestamp(F.make_timestamp(num(2).cast("int"), num(3).cast("int"), num(4).cast("int"), num(5).cast("int"), num(6).cast("int"), F.lit(0))) + num(7)
    out = rows.select(F.element_at("t", -1).try_cast("long").alias("eventid"), time.alias("time"), num(8).alias("lat"), num(9).alias("lon"), num(10).alias("depth"), num(11).alias("mb"))
    if start is not None:
        out = out.where(F.col("time") >= start)
    return out if end is None else out.where(F.col("time") <= end)


def read_waveforms(spark: SparkSession, index: DataFrame, path: str) -> DataFrame:
    """Samples for index rows (wfid, dfile, foff, nsamp, datatype, calib, ...) from binary files below path; gzipped files
    may stand for plain ones. dfile is a file's name, or the end of its path where names repeat. Files that no row names are left out by their path, before
    anything is read of them; a named file is read once, and all rows that name it are decoded from it in one task."""
    listed = spark.read.format("binaryFile").load(path).select("path").distinct()
    plain = F.regexp_replace("path", r"\.gz$", "")
    parts = F.split(plain, "/")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("dfile")
    named = listed.select("path", ends).join(index.select("dfile").distinct(), "dfile", "left_semi")
    columns = index.columns
    rows = index.join(named, "dfile").groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(rows, "path")

    def decode(batches):
        import gzip

        for batch in batches:
            for row in batch.to_pylist():
                raw = gzip.decompress(row["content"]) if row["path"].endswith(".gz") else row["content"]
                for r in row["rows"]:
                    width = 4 if r["datatype"] == "s4" else 3
                    r["samples"] = waves.decode_samples(raw[r["foff"] : r["foff"] + width * r["nsamp"]], r["datatype"], r["calib"]).tolist()
                yield pa.RecordBatch.from_pylist(row["rows"], schema=out)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    types = StructType([*index.schema.fields, StructField("samples", ArrayType(DoubleType()))])
    out = to_arrow_schema(types)
    return files.mapInArrow(decode, types)


#: Fixed values of the SAC format: bytes of a header, byte offsets of its floats, integers and texts, and what stands for a missing number.
SAC_HEADER, SAC_MISSING = 632, -12345
SAC_FLOATS = {"delta": 0, "b": 20, "e": 24, "stla": 124, "stlo": 128}
SAC_INTEGERS = {"nzyear": 280, "nzjday": 284, "nzhour": 288, "nzmin": 292, "nzsec": 296, "nzmsec": 300, "npts": 316}
SAC_TEXTS = {"kstnm": (440, 8), "kcmpnm": (600, 8)}


def index_sac_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, sta, chan, stime, etime, hz, npts) of the SAC files below path, of either byte order. Only headers leave the readers."""
    schema = "path string, sta string, chan string, stime double, etime double, hz double, npts long"

    def decode(batches):
        import struct

        for pdf in batches:
            rows = []
            for name, head in zip(pdf["path"], pdf["head"]):
                if len(head) < SAC_HEADER:
                    continue
                order = next((o for o in "<>" if struct.unpack_from(o + "i", head, 304)[0] in (6, 7)), None)
                if order is None:
                    continue
                f = {k: struct.unpack_from(order + "f", head, at)[0] for k, at in SAC_FLOATS.items()}
                n = {k: struct.unpack_from(order + "i", head, at)[0] for k, at in SAC_INTEGERS.items()}
                t = {k: head[at : at + size].decode("ascii", "replace").rstrip("\0 ") for k, (at, size) in SAC_TEXTS.items()}
                zero = datetime(n["nzyear"], 1, 1, tzinfo=timezone.utc).timestamp() + ((n["nzjday"] - 1) * 24 + n["nzhour"]) * 3600 + n["nzmin"] * 60 + n["nzsec"] + n["nzmsec"] / 1000
                begin = zero + (0.0 if f["b"] == SAC_MISSING else f["b"])
                rows.append((name, t["kstnm"], t["kcmpnm"], begin, begin + n["npts"] * f["delta"], 1 / f["delta"], n["npts"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", F.expr(f"substring(content, 1, {SAC_HEADER})").alias("head")).mapInPandas(decode, schema)


def append_trace(rows: DataFrame, path: str) -> None:
    """Adds rows of sampled states (chain, step, ...) to a table kept by chain; what is there stays as it is."""
    rows.repartition("chain").write.mode("append").partitionBy("chain").parquet(path)


def read_traces(spark: SparkSession, path: str, schema) -> DataFrame:
    """All states appended so far; a condition on chain reads only its folder."""
    return spark.read.schema(schema).parquet(path)


def appended(rows: DataFrame, path: str) -> None:
    """INSERT INTO a Parquet table ... SELECT: the columns by name, in the table's order and types."""
    table = rows.sparkSession.read.parquet(path).schema
    rows.select(*(F.col(f.name).cast(f.dataType) for f in table.fields)).write.mode("append").parquet(path)


def inserted(rows: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """INSERT INTO a Parquet table ... RETURNING the key: rows get the numbers after the table's greatest, in an order of their own columns, and come back with them. Numbers are made from
    range partitions and written down before they are used, so what comes back is what was appended. One writer at a time: two would begin at the same number."""
    from tremorlake.operators.sequences import ordinal

    last = rows.sparkSession.read.parquet(path).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = ordinal(rows.drop(key), [], order, key).withColumn(key, F.col(key) + last + 1)
    appended(numbered, path)
    return numbered


def merged_states(parts: list[DataFrame], periods: list[tuple[float, float]], time: str = "time") -> DataFrame:
    """Rows of each part within its half-open period, together."""
    kept = [p.where((F.col(time) >= a) & (F.col(time) < b)) for p, (a, b) in zip(parts, periods)]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def cloned_period(origin: DataFrame, assoc: DataFrame, arrival: DataFrame, sta, start: float, end: float) -> dict[str, DataFrame]:
    """A station's rows in a period, with the associations and origins that they lead to."""
    a = arrival.where((F.col("sta") == sta) & F.col("time").between(start, end))
    s = assoc.join(a.select("arid"), "arid", "left_semi")
    return {"arrival": a, "assoc": s, "origin": origin.join(s.select("orid"), "orid", "left_semi")}


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Deletion by key: what stays."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def updated(df: DataFrame, changes: DataFrame, on: str) -> DataFrame:
    """Values from changes where their key is there and they aren't null; all other rows as they are."""
    names = [c for c in changes.columns if c != on]
    new = changes.select(on, *(F.col(c).alias(f"_new_{c}") for c in names))
    return df.join(new, on, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))
