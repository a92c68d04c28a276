"""Events proposed from a library of historical waveforms.

Templates are found in windows by an inverted index of sketches. A sketch is ``tables`` words of ``bits`` signs of random projections; a template and the
samples under it share a word of a table with the probability (1 - angle / pi) ** bits. So the number of tables follows from the recall asked for at the
threshold itself, and what correlates better is found more surely; bits grow with the library, so that a word names a few templates at any size. Words that
no template has are dropped where they are made, by a bitmap of at most tables * 2**MOST_BITS / 8 bytes; the others meet the index in a shuffled join, and every
template that a window met is correlated exactly. So all hits are true, and the library may have any number of entries.

Where a station has few templates, words would be many times what they stand for and leave little out: there windows are dealt to blocks, once each, and correlated with all of their
station's templates, so that nothing is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Bits of a word at least and at most, templates that a word should name, and lags that are sketched at once.
LEAST_BITS, MOST_BITS, PER_WORD, LAGS = 4, 18, 4, 4096
#: Templates of a station at most that windows meet without an index, and windows in a block.
FEW, IN_BLOCK = 2048, 4096


def sketch_size(n_templates: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for a library: the chance to miss a hit at the threshold is 1 - recall."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n_templates) / PER_WORD))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _planes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Projections that don't see a segment's mean."""
    planes = np.random.Generator(np.random.PCG64([seed, size])).normal(size=(tables * bits, size))
    return planes - planes.mean(axis=1, keepdims=True)


def _words(segments: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """(segments, tables): the word of each segment in each table."""
    signs = (segments @ planes.T > 0).reshape(len(segments), -1, bits)
    return signs @ (1 << np.arange(bits))


def _samples(column) -> np.ndarray:
    return np.nan_to_num(np.array(column, float))


def template_words(templates: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(sta, size, tab, word, template): the index's postings."""

    def write(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            size, ids, stas, words = [], [], [], []
            for k, sta, x in zip(*(c.to_pylist() for c in batch.columns)):
                if len(x) not in known:
                    known[len(x)] = _planes(len(x), bits, tables, seed)
                words.append(_words(_samples(x)[None], known[len(x)], bits)[0])
                size.append(len(x))
                ids.append(k)
                stas.append(sta)
            n = len(ids)
            yield pa.record_batch([pa.array([x for x in stas for _ in range(tables)], pa.string()), pa.array(np.repeat(np.array(size, np.int32), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(np.concatenate(words).astype(np.int32) if n else np.zeros(0, np.int32)), pa.array(np.repeat(np.array(ids, np.int64), tables))], ["sta", "size", "tab", "word", "template"])

    return templates.select(F.col("template").cast("long"), F.col("sta").cast("string"), "samples").mapInArrow(write, "sta string, size int, tab int, word int, template long")


def window_words(windows: DataFrame, occupied: dict[int, np.ndarray], bits: int, tables: int, seed: int) -> DataFrame:
    """(sta, size, tab, word, window, lag) of the places under which the library has a word. occupied: of each size a bitmap over (tab, word)."""
    shared = windows.sparkSession.sparkContext.broadcast(occupied)

    def write(batches):
        planes = {size: _planes(size, bits, tables, seed) for size in shared.value}
        for batch in batches:
            for w, sta, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = _samples(x)
                for size, bitmap in shared.value.items():
                    if len(x) < size:
                        continue
                    places = np.lib.stride_tricks.sliding_window_view(x, size)
                    for a in range(0, len(places), LAGS):
                        words = _words(places[a : a + LAGS], planes[size], bits)
                        at = (np.arange(tables) << bits) + words
                        lag, tab = np.nonzero(bitmap[at >> 3] >> (at & 7) & 1)
                        n = len(lag)
                        yield pa.record_batch([pa.array([sta] * n, pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(tab.astype(np.int32)), pa.array(words[lag, tab].astype(np.int32)), pa.array(np.full(n, w, np.int64)), pa.array((lag + a).astype(np.int32))], ["sta", "size", "tab", "word", "window", "lag"])

    return windows.select(F.col("window").cast("long"), F.col("sta").cast("string"), "samples").mapInArrow(write, "sta string, size int, tab int, word int, window long, lag int")


def library_hits(windows: DataFrame, templates: DataFrame, threshold: float, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(window, template, lag, xc): places where a window's sliding correlation with a template of its station exceeds the threshold. windows: (window, sta,
    samples), templates: (template, sta, samples) of any lengths. Each such place is found with a probability of at least recall."""
    library = templates.where(F.size("samples") > 0)
    sizes = library.groupBy("sta").agg((F.count("*") > FEW).alias("_many"))
    some = lambda rows, many: rows.join(sizes.where(F.col("_many") == many).select("sta"), "sta", "left_semi")
    direct = _all_hits(windows, some(library, False), threshold)
    if sizes.where("_many").isEmpty():
        return direct
    return direct.unionByName(_indexed_hits(some(windows, True), some(library, True), threshold, recall, seed))


def _all_hits(windows: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """Every hit, by all correlations of a station's windows and templates."""
    blocks = windows.groupBy("sta").agg(F.ceil(F.count("*") / IN_BLOCK).cast("long").alias("_n"))
    asked = windows.join(blocks, "sta").select(F.col("sta").cast("string").alias("_sta"), F.pmod(F.xxhash64("window"), "_n").alias("_block"), F.col("window").cast("long").alias("window"), "samples")
    known = library.join(blocks, "sta").select(F.col("sta").cast("string").alias("_of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part"), F.col("template").cast("long").alias("template"), "samples")

    def correlate(asked: pa.Table, known: pa.Table) -> pa.Table:
        by_size: dict[int, tuple[list, list]] = {}
        for k, t in zip(known["template"].to_pylist(), known["samples"]):
            t = _samples(t.as_py())
            ids, rows = by_size.setdefault(len(t), ([], []))
            ids.append(k)
            rows.append(t - t.mean())
        groups = [(np.array(ids), np.array(rows), np.linalg.norm(rows, axis=1)) for ids, rows in by_size.values()]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        for w, x in zip(asked["window"].to_pylist(), asked["samples"]):
            x = _samples(x.as_py())
            for ids, rows, norms in groups:
                if len(x) < rows.shape[1]:
                    continue
                every = np.lib.stride_tricks.sliding_window_view(x, rows.shape[1])
                for a in range(0, len(every), LAGS):
                    places = every[a : a + LAGS]
                    norm = np.linalg.norm(places, axis=1)[:, None] * norms
                    xc = np.divide(places @ rows.T, norm, out=np.zeros(norm.shape), where=norm > 1e-12)
                    lag, k = np.nonzero(xc > threshold)
                    out.append((np.full(len(lag), w), ids[k], (lag + a).astype(np.int32), xc[lag, k]))
        return pa.table(dict(zip(("window", "template", "lag", "xc"), (np.concatenate(c) for c in zip(*out)))))

    return asked.groupBy("_sta", "_block").cogroup(known.groupBy("_of", "_part")).applyInArrow(correlate, "window long, template long, lag int, xc double")


def _indexed_hits(windows: DataFrame, library: DataFrame, threshold: float, recall: float, seed: int) -> DataFrame:
    """Hits by the index of sketches."""
    most = library.groupBy("sta").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    bits, tables = sketch_size(most or 1, threshold, recall)
    index = checkpointed(template_words(library, bits, tables, seed))
    # a row for each size, table and eight words: a bitmap's bytes
    byte = F.shiftleft(F.col("tab"), bits) + F.col("word")
    rows = index.select("size", F.floor(byte / 8).cast("int").alias("byte"), F.expr(f"shiftleft(1, cast((shiftleft(tab, {bits}) + word) % 8 AS int))").alias("bit")).groupBy("size", "byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    occupied: dict[int, np.ndarray] = {}
    for size, part in rows.groupby("size"):
        occupied[int(size)] = np.zeros((tables << bits) // 8 + 1, np.uint8)
        occupied[int(size)][part["byte"].to_numpy()] = part["bits"].to_numpy()
    met = window_words(windows, occupied, bits, tables, seed).join(index, ["sta", "size", "tab", "word"]).groupBy("window", "template").agg(F.collect_set("lag").alias("lags"))
    both = met.join(windows.select(F.col("window").cast("long"), F.col("samples").alias("x")), "window").join(library.select(F.col("template").cast("long"), F.col("samples").alias("t")), "template")

    def correlate(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                t, x = _samples(row["t"]), _samples(row["x"])
                t = t - t.mean()
                lags = np.sort(np.array(row["lags"]))
                places = np.lib.stride_tricks.sliding_window_view(x, len(t))[lags]
                norm = np.linalg.norm(places, axis=1) * np.linalg.norm(t)
                xc = np.divide(places @ t, norm, out=np.zeros(len(lags)), where=norm > 1e-12)
                out += [(row["window"], row["template"], int(k), float(v)) for k, v in zip(lags, xc) if v > threshold]
            w, t, k, v = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(w, pa.int64()), pa.array(t, pa.int64()), pa.array(k, pa.int32()), pa.array(v, pa.float64())], ["window", "template", "lag", "xc"])

    return both.select("window", "template", "lags", "x", "t").mapInArrow(correlate, "window long, template long, lag int, xc double")


def proposals(hits: DataFrame, windows: DataFrame, history: DataFrame, bin_seconds: float = 5.0, uniform: float = 0.05) -> DataFrame:
    """(evid, otime, n_sta, score, weight): events to propose, at the places of historical ones, from hits of their waveforms.

    windows: (window, sta, stime, srate); history: (template, evid, sta, travel_time, n), n being its samples. A hit puts the event's origin at its own time less the
    travel time. Of a station's hits in a bin of origin times the best counts, as the log-likelihood that a template takes off white noise; a bin's score is the sum over stations, an event's
    proposal its best bin. Weights are the scores' shares over all proposals by exp, mixed with a uniform share."""
    at = hits.join(windows.select("window", "sta", "stime", "srate"), "window").join(history.withColumnRenamed("sta", "h_sta"), "template").where("sta = h_sta")
    gain = -F.col("n") / 2 * F.log1p(-F.least(F.col("xc") * F.col("xc"), F.lit(1 - 1e-12)))
    origin = F.col("stime") + F.col("lag") / F.col("srate") - F.col("travel_time")
    best = at.select("evid", "sta", F.floor(origin / bin_seconds).cast("long").alias("bin"), origin.alias("origin"), gain.alias("gain")).groupBy("evid", "bin", "sta").agg(F.max(F.struct("gain", "origin")).alias("b"))
    bins = best.groupBy("evid", "bin").agg(F.count("*").alias("n_sta"), F.sum("b.gain").alias("score"), (F.sum(F.col("b.gain") * F.col("b.origin")) / F.sum("b.gain")).alias("otime"))
    top = bins.groupBy("evid").agg(F.max(F.struct("score", F.col("n_sta"), F.col("otime"))).alias("p")).select("evid", "p.otime", "p.n_sta", "p.score")
    top = checkpointed(top)
    whole = top.agg(F.max("score").alias("_most"), F.count("*").alias("_n"))
    total = top.join(F.broadcast(whole.select("_most")), how="cross").agg(F.sum(F.exp(F.col("score") - F.col("_most"))).alias("_total"))  # single rows
    share = F.exp(F.col("score") - F.col("_most")) / F.col("_total")
    return top.join(F.broadcast(whole), how="cross").join(F.broadcast(total), how="cross").select("evid", "otime", "n_sta", "score", ((1 - uniform) * share + uniform / F.col("_n")).alias("weight"))
