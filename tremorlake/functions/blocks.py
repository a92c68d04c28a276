"""Blocks of time that a period is worked in, as columns of number and bounds; a block has its start, but not its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def fixed_block(t, stime, etime, seconds: float) -> Column:
    """Struct (block, stime, etime): the period's blocks are ``seconds`` long, but the last one, which is stretched to the period's end, as is the only one of a shorter period. Null outside
    the period. Arguments are columns' names or numbers."""
    t, first, last = _col(t), _col(stime), _col(etime)
    n = F.greatest(F.lit(1), F.floor((last - first) / seconds))
    k = F.least(F.floor((t - first) / seconds), n - 1).cast("long")
    end = F.when(k == n - 1, last).otherwise(first + (k + 1) * seconds)
    return F.when((t >= first) & (t < last), F.struct(k.alias("block"), (first + k * seconds).cast("double").alias("stime"), end.cast("double").alias("etime")))


def equal_block(t, stime, etime, most_seconds: float) -> Column:
    """The same of as few equally long blocks as are no longer than ``most_seconds``."""
    t, first, last = _col(t), _col(stime), _col(etime)
    n = F.ceil((last - first) / most_seconds)
    length = (last - first) / n
    # a time may divide to its block's number from below: what counts are the bounds
    k = F.floor((t - first) / length)
    k = F.greatest(F.lit(0), F.least(k + F.when(t >= first + (k + 1) * length, 1).otherwise(0) - F.when(t < first + k * length, 1).otherwise(0), n - 1)).cast("long")
    end = F.when(k == n - 1, last).otherwise(first + (k + 1) * length)
    return F.when((t >= first) & (t < last), F.struct(k.alias("block"), (first + k * length).cast("double").alias("stime"), end.cast("double").alias("etime")))
