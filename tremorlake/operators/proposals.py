"""Events proposed from a grid of scores: prior, probabilities, local maxima, and a finer grid inside each of them.

A grid has a row (cell, tbin, score, n) for each cell and time bin that any detection supports, as ``models.event_grid`` gives it; all other bins have the score 0 and are
counted, not listed. Rows with a null score count for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import votes
from .lineage import stored

#: Digits of scores that count where the greatest is looked for, so that what rounding does to sums decides nothing.
DIGITS = 6
#: Time bins whose maxima are looked for together.
BINS = 512


def cell_prior(cell: Column, lon_step: float, lat_step: float, expected: float) -> Column:
    """Events in a cell and time bin, of so many expected in a bin all over the sphere: the cell's share of its area."""
    n_lon = int(360 / lon_step)
    low = F.floor(cell / n_lon) * lat_step - 90
    return expected * (F.sin(F.radians(low + lat_step)) - F.sin(F.radians(low))) / (2 * n_lon)


def with_probabilities(grid: DataFrame, lon_step: float, lat_step: float, tick: float, rate: float) -> DataFrame:
    """Adds odds (logarithm), p_bin and p_one. p_bin: that an event is in the bin, whatever is in others. p_one: that the one event there is, is in this bin, among
    all cells and all time bins from the first to the last of the grid, supported or not. rate: events a second."""
    prior = cell_prior(F.col("cell"), lon_step, lat_step, rate * tick)
    rows = stored(grid.where("score IS NOT NULL"), "grid").withColumn("_prior", prior).withColumn("_log", F.col("score") + F.ln("_prior"))
    whole = rows.agg(F.max("_log").alias("_m"), F.sum("_prior").alias("_listed"), (F.max("tbin") - F.min("tbin") + 1).alias("_bins"))
    weighed = rows.join(whole, how="cross")  # a single row
    total = weighed.groupBy("_m", "_listed", "_bins").agg(F.sum(F.exp(F.col("_log") - F.col("_m"))).alias("_sum"))
    rest = F.greatest(F.lit(0.0), F.col("_bins") * (rate * tick) - F.col("_listed")) * F.exp(-F.col("_m"))
    share = total.select("_m", (F.col("_sum") + rest).alias("_total"))
    odds = F.col("_log") - F.log1p(-F.col("_prior"))
    out = rows.join(share, how="cross").withColumn("odds", odds)  # a single row
    return out.select(*grid.columns, "odds", (1 / (1 + F.exp(-F.col("odds")))).alias("p_bin"), (F.exp(F.col("_log") - F.col("_m")) / F.col("_total")).alias("p_one"))


def local_maxima(grid: DataFrame, lon_step: float, lat_step: float, least: float, reach: int = 1) -> DataFrame:
    """Rows with odds of at least ``least`` that no row beside them surpasses: in the eight cells around (over the date line, not over the poles) and in up to ``reach`` time
    bins before and after. Of equals that of the smaller cell, then of the earlier bin, counts. Rows below the bound surpass none above it, so they stay out from the start."""
    n_lon, n_lat = int(360 / lon_step), int(180 / lat_step)
    names, period = grid.columns, lambda t: F.floor(t / BINS)
    rows = grid.where(F.col("odds") >= least).withColumn("_rank", F.round("odds", DIGITS))
    # rows near a period's border are looked at in both, and kept in their own
    dealt = rows.withColumn("_period", F.explode(F.sequence(period(F.col("tbin") - reach), period(F.col("tbin") + reach))))

    def keep(table: pa.Table) -> pa.Table:
        cell, tbin, odds = (table[c].to_numpy().astype(t) for c, t in (("cell", np.int64), ("tbin", np.int64), ("_rank", float)))
        order = np.lexsort((-tbin, -cell, odds))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = tbin * (n_lon * n_lat) + cell
        by_place = np.argsort(at)
        places = at[by_place]
        line, place = cell // n_lon, cell % n_lon
        best = tbin // BINS == table["_period"][0].as_py()
        for y in (-1, 0, 1):
            for x in (-1, 0, 1):
                for t in range(-reach, reach + 1):
                    beside = (tbin + t) * (n_lon * n_lat) + (line + y) * n_lon + (place + x) % n_lon
                    k = np.minimum(np.searchsorted(places, beside), len(places) - 1)
                    best &= ~((places[k] == beside) & (line + y >= 0) & (line + y < n_lat) & (rank[by_place[k]] > rank))
        return table.select(names).filter(pa.array(best))

    return dealt.groupBy("_period").applyInArrow(keep, grid.schema)


def refined(proposals: DataFrame, templates: DataFrame, stations: DataFrame, lon_step: float, lat_step: float, tick: float, fan: int = 5, speed_km_s: float = 8.0, scale: float = 5.0, log_rate: float = -8.0) -> DataFrame:
    """(cell, tbin, lon, lat, time, fine_score, p): the best of fan * fan places in each proposal's cell and of the half bins in its time bin and those beside it, with its share of
    the probability of all of these. Scores are made as in the grid, from the templates (sta, phase, atime) that any such place and time may explain. Proposals without any stay out."""
    n_lon, fine, bins = int(360 / lon_step), tick / 2, votes.bins_in_period(tick, speed_km_s)
    near = votes.dealt(templates, stations, tick, speed_km_s, slack=2.5 * tick)
    wanted = proposals.select(F.floor(F.col("tbin") / bins).alias("period"), F.col("cell").cast("long").alias("cell"), F.col("tbin").cast("long").alias("tbin")).distinct()
    child = np.arange(fan * fan)

    def refine(asked: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(table):
            picks, period = votes.Picks(table, 3 * fine), asked["period"][0].as_py()
            # half bins of the period and of a bin on either side
            low = (period * bins - 1) * 2
            cells, tbins = asked["cell"].to_numpy(), asked["tbin"].to_numpy()
            for cell in np.unique(cells):
                tbin = np.sort(tbins[cells == cell])
                places = cell % n_lon * lon_step - 180 + (child % fan + 0.5) * (lon_step / fan), cell // n_lon * lat_step - 90 + (child // fan + 0.5) * (lat_step / fan)
                mine = (tbin * 2 - 2 - low)[:, None] + np.arange(6)
                listed, at = np.unique(mine, return_inverse=True)
                slot = np.full(2 * bins + 4, -1)
                slot[listed] = np.arange(len(listed))
                score, n = votes.scores(picks, *places, fine, low, slot, len(listed), speed_km_s, scale, log_rate)
                # all half bins of a proposal by place and time
                each = score[:, at.reshape(mine.shape)].transpose(1, 0, 2).reshape(len(tbin), -1)
                top = np.argmax(np.where(n[:, at.reshape(mine.shape)].transpose(1, 0, 2).reshape(each.shape) > 0, np.round(each, DIGITS), -np.inf), axis=1)
                most = each[np.arange(len(tbin)), top]
                share = 1 / np.exp(each - most[:, None]).sum(axis=1)
                some = n[:, at.reshape(mine.shape)].sum(axis=(0, 2)) > 0
                fbin = tbin * 2 - 2 + top % 6
                out.append([x[some] for x in (np.full(len(tbin), cell), tbin, places[0][top // 6], places[1][top // 6], (fbin + 0.5) * fine, most, share)])
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 5
        return pa.table(dict(zip(("cell", "tbin", "lon", "lat", "time", "fine_score", "p"), columns)))

    got = wanted.groupBy("period").cogroup(near.groupBy("period")).applyInArrow(refine, "cell long, tbin long, lon double, lat double, time double, fine_score double, p double")
    return got.withColumns({c: F.col(c).cast(proposals.schema[c].dataType) for c in ("cell", "tbin")})
