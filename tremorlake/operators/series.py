"""Waveforms as rows with an array column ``samples`` (null: masked) and a rate ``srate``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import waves


#: New columns' types in Spark's DDL and in Arrow.
TYPES = {
    "array<double>": pa.list_(pa.float64()),
    "double": pa.float64(),
    "int": pa.int32(),
    "array<struct<template:int,lag:int,xc:double>>": pa.list_(pa.struct([("template", pa.int32()), ("lag", pa.int32()), ("xc", pa.float64())])),
}


def _series_of(column: pa.Array) -> list[np.ndarray]:
    """A list column's rows as views of its flat values; nulls are NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1]
    return np.split(flat, ends)


def _array_of(values: list, kind: pa.DataType) -> pa.Array:
    if not kind.equals(pa.list_(pa.float64())):
        return pa.array(values, kind)
    sizes = np.array([len(v) for v in values])
    flat = np.concatenate([np.asarray(v, float) for v in values]) if len(values) else np.zeros(0)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat, from_pandas=True))


def map_samples(rows: DataFrame, kernel, **new: str) -> DataFrame:
    """One pass over rows: kernel(samples, the row as a dict, its lists as arrays) -> a tuple of the new columns, named with their types.
    Series stay Arrow buffers and numpy views; NaN becomes null."""
    kept = [c for c in rows.columns if c not in new]
    types = [TYPES[t] for t in new.values()]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: _series_of(x) if pa.types.is_list(x.type) and (pa.types.is_floating(x.type.value_type) or pa.types.is_integer(x.type.value_type)) else x.to_pylist() for c, x in zip(batch.schema.names, batch.columns)}
            out = [kernel(row["samples"], row) for row in (dict(zip(columns, r)) for r in zip(*columns.values()))]
            made = [_array_of([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], [*kept, *new])

    base = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept]
    return rows.mapInArrow(run, ", ".join(base + [f"{n} {t}" for n, t in new.items()]))


def filtered(waves_df: DataFrame, chain: str, canonical: bool = False) -> DataFrame:
    """Applies a whole chain of filters in one pass; samples and srate change."""
    waves.parse_chain(chain, canonical)

    def kernel(x, row):
        y, rate = waves.apply_chain(x, float(row["srate"]), chain, canonical)
        return y, float(rate)

    return map_samples(waves_df, kernel, samples="array<double>", srate="double")


def centered(x: str = "samples") -> Column:
    mean = F.aggregate(F.filter(x, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v) / F.size(F.filter(x, lambda v: v.isNotNull()))
    return F.transform(x, lambda v: v - mean)


def logged(x: str = "samples") -> Column:
    return F.transform(x, lambda v: F.when(v > 0, F.ln(v)))


def sliced(t0, t1, x: str = "samples", stime: str = "stime", srate: str = "srate") -> Column:
    """Samples of [t0, t1)."""
    i = ((t0 - F.col(stime)) * F.col(srate)).cast("int")
    j = ((t1 - F.col(stime)) * F.col(srate)).cast("int")
    return F.slice(x, i + 1, F.greatest(j - i, F.lit(0)))


def fraction_valid(x: str = "samples") -> Column:
    return F.size(F.filter(x, lambda v: v.isNotNull())) / F.size(x)


def l1_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def block_means(x: str, k: int) -> Column:
    """Means of k neighbouring samples; a ragged rest is cut off."""
    n = F.floor(F.size(x) / k).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.aggregate(F.slice(x, i * k + 1, k), F.lit(0.0), lambda s, v: s + v) / k)


def shifted_sum(a: str, b: str, offset: int, default: float = 0.0) -> Column:
    """a plus b moved by offset samples, over a's span; where b has none the default."""
    return F.transform(a, lambda v, i: v + F.coalesce(F.try_element_at(b, F.when(i - offset >= 0, i - offset + 1)), F.lit(default)))


def envelope_template(arrival: Column, peak_offset: Column, coda_height: Column, coda_decay: Column, srate: float, seconds: int, floor: float = -7.0) -> Column:
    """Log envelope of a paired-exponential template on a grid from its arrival: the floor, a linear rise in amplitude to
    the peak, then a straight decay. peak_offset and coda_decay are logarithms."""
    peak = F.exp(peak_offset) * srate
    slope = F.when(peak > 0, F.exp(coda_height) / peak).otherwise(0.0)
    rise = F.floor(peak) + 1
    base = float(np.exp(floor))

    def value(i):
        return F.when(i == 0, floor).when(i < rise, F.ln(i * slope + base)).otherwise((i - peak) / srate * -F.exp(coda_decay) + coda_height)

    return F.transform(F.sequence(F.lit(0), F.lit(int(seconds * srate) - 1)), value)


def correlations(windows: DataFrame, templates: list[tuple[int, list[float]]], threshold: float) -> DataFrame:
    """(all columns, template, lag, xc): places where a window's sliding correlation with a template exceeds a threshold.
    Templates are a short library that goes with the task."""
    library = [(int(k), np.array(t, float)) for k, t in templates]
    if len(library) > 10_000:
        raise ValueError("a template library has at most 10000 entries")

    def kernel(x, row):
        hits = []
        for k, t in library:
            xc = waves.sliding_correlation(t - t.mean(), np.nan_to_num(x))
            hits += [{"template": k, "lag": int(i), "xc": float(xc[i])} for i in np.flatnonzero(xc > threshold)]
        return (hits,)

    found = map_samples(windows, kernel, hits="array<struct<template:int,lag:int,xc:double>>")
    return found.select(*[c for c in windows.columns if c != "samples"], F.inline("hits"))


def best_correlation(pairs: DataFrame, most: int) -> DataFrame:
    """Adds xc and shift: the best correlation of samples with other over small shifts."""

    def kernel(x, row):
        return waves.two_way_correlation(x, row["other"], most)

    return map_samples(pairs, kernel, xc="double", shift="int")


def ar_models(rows: DataFrame, order: int) -> DataFrame:
    """Adds phi, sigma and loglik of an AR model of each row's samples."""

    def kernel(x, row):
        phi, sigma = waves.yule_walker(x, order)
        return phi, sigma, waves.ar_log_likelihood(x, float(np.nanmean(x)), phi, sigma)

    return map_samples(rows, kernel, phi="array<double>", sigma="double", loglik="double")


def spectrum(rows: DataFrame) -> DataFrame:
    """Adds power: squared magnitude at the FFT's frequencies."""
    return map_samples(rows, lambda x, row: ((np.abs(np.fft.rfft(np.nan_to_num(x))) ** 2 / max(1, len(x))),), power="array<double>")


def stitched(requests: DataFrame, files: DataFrame, pad_seconds: float = 0.0, mirror: bool = False) -> DataFrame:
    """One waveform per request (rid, sta, chan, stime, etime) from files (sta, chan, time, srate, samples) that overlap
    it: samples go to their places on a grid of the least rate there is, later files over earlier ones; files of a multiple of that
    rate are decimated, any other rate is an error. Gaps are null, or filled by reflection and only null in the padding at both ends."""
    from .joins import overlap_join

    spans = files.select("sta", "chan", F.col("time").alias("ftime"), (F.col("time") + F.size("samples") / F.col("srate")).alias("fend"), F.col("srate").alias("frate"), F.col("samples").alias("fsamples"))
    both = overlap_join(requests, spans, ("stime", "etime"), ("ftime", "fend"), 3600.0, keys=["sta", "chan"])

    def stitch(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ftime", "frate"], kind="stable")
        r, rate = part.iloc[0], float(part["frate"].min())
        grid = np.full(int(round((r["etime"] - r["stime"]) * rate)), np.nan)
        for f in part.itertuples():
            at = int(np.floor((f.ftime - r["stime"]) * rate + 1e-4))
            x, _ = waves.decimate(np.array(f.fsamples, float), float(f.frate), rate)
            lo, hi = max(0, -at), min(len(x), len(grid) - at)
            if hi > lo:
                grid[at + lo : at + hi] = x[lo:hi]
        if mirror:
            grid = waves.mirror_missing(grid)
        edge = int(pad_seconds * rate)
        if edge:
            grid[:edge] = grid[len(grid) - edge :] = np.nan
        return pd.DataFrame({"rid": [r["rid"]], "sta": [r["sta"]], "chan": [r["chan"]], "stime": [r["stime"]], "srate": [rate], "samples": [[None if np.isnan(x) else float(x) for x in grid]]})

    s = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    return both.groupBy("rid").applyInPandas(stitch, f"rid {s['rid']}, sta {s['sta']}, chan {s['chan']}, stime double, srate double, samples array<double>")
