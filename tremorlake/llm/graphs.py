"""Connected components whose rounds are cut by written tables; each round's table goes once the next one is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tremorlake.operators import graphs

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of the undirected edges (a, b) is connected with, by stars at any size."""
    return graphs.components(edges, lambda df: written(df, "edges"), discard, few=0)
