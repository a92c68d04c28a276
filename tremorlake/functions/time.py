"""Epoch seconds as doubles are the canonical time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(column: str | Column) -> Column:
    """Seconds since 1970 as a double, with micro-seconds; the session's time zone has to be UTC."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
