"""Names of bands, filters, channels, dates and nodes: strings to values and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vertical channels that stand for one another.
VERTICAL = ("BHZ", "EHZ", "SHZ", "HHZ", "sz", "bz", "mz", "hz", "ez")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band_low(name) -> Column:
    return F.regexp_extract(_c(name), r"freq_([0-9.]+)_([0-9.]+)", 1).try_cast("double")


def band_high(name) -> Column:
    return F.regexp_extract(_c(name), r"freq_([0-9.]+)_([0-9.]+)", 2).try_cast("double")


def band_hz(name) -> Column:
    """Middle of a band."""
    return (band_low(name) + band_high(name)) / 2


def filter_band(text) -> Column:
    """The band among the filters of a chain, null if there is none."""
    found = F.regexp_extract(_c(text), r"(freq_[0-9.]+_[0-9.]+)", 1)
    return F.when(found != "", found)


def filter_smoothing(text) -> Column:
    return F.regexp_extract(_c(text), r"smooth_?([0-9]+)", 1).try_cast("int")


def canonical_channel(chan) -> Column:
    return F.when(_c(chan).isin(*VERTICAL), "BHZ").otherwise(_c(chan))


def julian_to_epoch(yyyyddd) -> Column:
    """Seconds at the start of a day YYYYDDD; -1 (open) is null."""
    n = _c(yyyyddd).cast("int")
    day = F.date_add(F.make_date(F.floor(n / 1000).cast("int"), F.lit(1), F.lit(1)), n % 1000 - 1)
    return F.when(n > 0, F.unix_date(day).cast("double") * 86400)


def node_key(*parts) -> Column:
    return F.concat_ws(";", *(_c(p) for p in parts))


def node_part(key, i: int) -> Column:
    return F.element_at(F.split(_c(key), ";"), i)


def trunc_digits(x, digits: int) -> Column:
    """Cuts a number to digits behind the point, toward zero."""
    k = 10.0**digits
    return (_c(x) * k).cast("bigint").cast("double") / k
