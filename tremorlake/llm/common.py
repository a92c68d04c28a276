"""What the text operators share: clean inputs, bounded blocks of text, hashes of byte and word windows.

All operators take a table with at least ``doc_id`` and ``text``. Other columns are ignored by them, so
extra columns never clash. A null text is an empty text. A row without ``doc_id`` has no identity to report
on and is left out of every result. Repeated rows are kept as they come.
"""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.lineage import shared_path

#: Bytes of text that a Python worker handles at once; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Rows of a block at most, so that a row's place fits 16 bits.
BLOCK_ROWS = 1 << 15
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Where the session has Spark's own limit of rows for an Arrow batch, it gets a lower one: a batch of long texts has to fit a
    worker. A session that sets its own keeps it."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; rows without doc_id go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing will read again."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)


def blocks(batches, columns=("doc_id",), most=BLOCK_BYTES):
    """(columns as Arrow arrays, bytes, offsets) of at most ``most`` bytes of text and BLOCK_ROWS rows, in the order of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, i + BLOCK_ROWS, len(text))
            part = batch.slice(i, j - i)
            yield [part.column(part.schema.get_field_index(c)) for c in columns], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


#: A random odd number for each byte value, and odd multipliers for spans of 1, 2, 4, ... items.
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPAN = _RNG.integers(1, 2**63, 40, dtype=np.uint64) | np.uint64(1)


def span_hashes(codes: np.ndarray, size: int, parts: dict | None = None) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring codes (uint64), by doubling; parts gets those of the powers of two."""
    with np.errstate(over="ignore"):
        out, done, level, k = None, 0, codes, 0
        while True:
            width = 1 << k
            if parts is not None:
                parts[width] = level
            if size & width:
                if out is None:
                    out = level
                else:
                    n = max(0, len(codes) - done - width + 1)
                    out = out[:n] * SPAN[k + 20] + level[done : done + n]
                done += width
            if width * 2 > size:
                break
            n = max(0, len(level) - width)
            level = level[:n] * SPAN[k] + level[width : width + n]
            k += 1
        return out[: max(0, len(codes) - size + 1)]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    if len(values) < size:
        return values[:0]
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n), base)]), dtype=np.uint64)


class RunHasher:
    """64-bit hashes of byte runs of any length, by prefix sums of powers; keeps its tables of powers."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(_POWER, len(data)), _powers(_INVERSE, len(data))
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_CODE[data] * self.up[: len(data)], out=total[1:])
            return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def runs_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a text's border."""
    n = len(mask)
    first = mask.copy()
    if n:
        first[1:] &= ~mask[:-1]
        border = offsets[(offsets > 0) & (offsets < n)]
        first[border] = mask[border]
    starts = np.flatnonzero(first)
    last = mask.copy()
    if n:
        last[:-1] &= ~mask[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


#: Bytes that end a word: space and the control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, hasher: RunHasher):
    """Start and end of each word, its hash, and the index of each text's first word (one more at the end)."""
    starts, ends = runs_of(inside[data], offsets)
    return starts, ends, hasher(data, starts, ends), np.searchsorted(starts, offsets)
