"""Votes of detections for origin times at places, counted period by period.

A detection speaks for origin times up to the longest travel time before its own, so it goes to the one or two periods of bins that it can reach, and each bin is counted in one place: rows
of detections are shuffled, not their votes. Within a period votes are made and summed by numpy, a block of detections at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo

RADIUS = float(geo.EARTH_RADIUS_KM)
#: Places times detections that are looked at side by side.
BLOCK = 1 << 19


def bins_in_period(tick: float, speed_km_s: float) -> int:
    """About two longest travel times, so that a detection reaches few periods."""
    return max(8, math.ceil(2 * math.pi * RADIUS / speed_km_s / tick))


def dealt(templates: DataFrame, stations: DataFrame, tick: float, speed_km_s: float, slack: float = 0.0) -> DataFrame:
    """(period, sta, phase, atime, slon, slat): each template in all periods of origin times that it can speak for, give or take the slack in seconds."""
    bins, widest = bins_in_period(tick, speed_km_s), math.pi * RADIUS / speed_km_s + slack + 2 * tick
    period = lambda t: F.floor(F.floor(t / tick) / bins)
    placed = templates.select("sta", "phase", F.col("atime").cast("double").alias("atime")).join(stations.select("sta", F.col("slon").cast("double").alias("slon"), F.col("slat").cast("double").alias("slat")), "sta")
    known = placed.where("atime IS NOT NULL AND slon IS NOT NULL AND slat IS NOT NULL")
    return known.select(F.explode(F.sequence(period(F.col("atime") - widest), period(F.col("atime") + (slack + 2 * tick)))).alias("period"), "sta", "phase", "atime", "slon", "slat")


class Picks:
    """A period's detections as arrays: those that share a station and phase with another one near in time come last, from ``first_close`` on."""

    def __init__(self, table: pa.Table, near: float):
        code = lambda c: pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode")
        sta, phase = code("sta"), code("phase")
        group = sta.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(phase.dictionary) + phase.indices.to_numpy(zero_copy_only=False)
        atime, lon, lat = (table[c].to_numpy() for c in ("atime", "slon", "slat"))
        order = np.lexsort((atime, group))
        group, atime, lon, lat = group[order], atime[order], lon[order], lat[order]
        same = group[1:] == group[:-1]
        pair = same & (np.diff(atime) <= near)
        close = np.append(pair, False) | np.append(False, pair)
        # a station at several places: how far its votes lie apart is no matter of times alone
        moved = same & ((np.diff(lon) != 0) | (np.diff(lat) != 0))
        close |= np.isin(group, group[1:][moved])
        order = np.argsort(close, kind="stable")
        self.group, self.atime, self.lon, self.lat = group[order], atime[order], np.radians(lon[order]), np.radians(lat[order])
        self.first_close = int(len(close) - close.sum())


def _cdf(z: np.ndarray) -> np.ndarray:
    e = 0.5 * np.exp(-np.abs(z))
    return np.where(z < 0, e, 1 - e)


def scores(picks: Picks, lon: np.ndarray, lat: np.ndarray, width: float, low: int, slot: np.ndarray, n_slots: int, speed_km_s: float, scale: float, log_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of votes, (places, n_slots) each. slot: of the bins from low on, where each one is summed, or -1. A vote is the logarithm of the Laplace mass of a bin or
    one beside it, less the rate of false detections; of a station and phase only the best in a bin counts."""
    lon, lat = np.radians(lon)[:, None], np.radians(lat)[:, None]
    total, count = np.zeros(len(lon) * n_slots), np.zeros(len(lon) * n_slots, np.int64)
    least = width * math.exp(log_rate)

    def votes(a: int, b: int):
        chord = np.sin((lat - picks.lat[a:b]) / 2) ** 2 + np.cos(lat) * np.cos(picks.lat[a:b]) * np.sin((lon - picks.lon[a:b]) / 2) ** 2
        t0 = picks.atime[a:b] - 2 * np.arcsin(np.sqrt(np.clip(chord, 0.0, 1.0))) * RADIUS / speed_km_s
        mid = np.floor(t0 / width).astype(np.int64) - low
        at = np.flatnonzero((mid >= -1) & (mid <= len(slot)))
        t0, mid, pick = t0.ravel()[at], mid.ravel()[at], at % (b - a) + a
        base = at // (b - a) * n_slots
        for move in (-1, 0, 1):
            k = mid + move
            s = np.where((k >= 0) & (k < len(slot)), slot[np.clip(k, 0, len(slot) - 1)], -1)
            some = np.flatnonzero(s >= 0)
            left = ((k[some] + low) * width - t0[some]) / scale
            mass = _cdf(left + width / scale) - _cdf(left)
            good = mass > least
            some = some[good]
            yield base[some] + s[some], picks.group[pick[some]], mass[good]

    def add(key, mass):
        nonlocal total, count
        total += np.bincount(key, np.log(mass) - (math.log(width) + log_rate), len(total))
        count += np.bincount(key, minlength=len(count))

    many = max(1, BLOCK // len(lon))
    for a in range(0, picks.first_close, many):
        for key, _, mass in votes(a, min(a + many, picks.first_close)):
            add(key, mass)
    # whole groups at a time, so that the best of each can be told
    a, end = picks.first_close, len(picks.atime)
    while a < end:
        b = min(a + many, end)
        b = int(np.searchsorted(picks.group[a:], picks.group[b - 1], "right")) + a
        key, group, mass = (np.concatenate(x) for x in zip(*votes(a, b)))
        order = np.lexsort((mass, key, group))
        last = np.append((np.diff(key[order]) != 0) | (np.diff(group[order]) != 0), True)[: len(order)]
        add(key[order][last], mass[order][last])
        a = b
    return total.reshape(len(lon), n_slots), count.reshape(len(lon), n_slots)
