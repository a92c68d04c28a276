"""Graphs as tables of edges: connected components, levels of a directed graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Edges up to which one task finds the components by itself.
FEW_EDGES = 200_000
#: Neighbours of a node whose rows are dealt by broadcast, at least, and how many such nodes there may be.
HUB, MOST_HUBS = 200, 100_000


def _least_of_hubs(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows joined with (u, m, k) by u: nodes of many neighbours by broadcast (MOST_HUBS at most), others by a shuffle."""
    some = max(HUB, -(-n_edges // MOST_HUBS))
    hubs, others = least.where(F.col("k") >= some).drop("k"), least.where(F.col("k") < some).drop("k")
    marked = rows.join(F.broadcast(hubs), "u", "left")
    return marked.where("m IS NOT NULL").unionByName(marked.where("m IS NULL").drop("m").join(others, "u"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, with that one."""

    def find(batches):
        parent: dict[int, int] = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in list(parent)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"]).astype("int64")

    return edges.coalesce(1).mapInPandas(find, "u long, v long")


def components(edges: DataFrame, cut: Callable = checkpointed, drop: Callable = lambda df: None, few: int = FEW_EDGES) -> DataFrame:
    """(id, component): the smallest id that each node of the undirected edges (a, b) is connected with.

    ``few`` edges or less are gone through in one task. More take alternating large and small stars: each round joins every node
    with the least of its neighbours, so long paths shrink by half, and hubs never gather their neighbours in one row. Rounds go on
    until nothing changes; cut writes a round's edges and drop removes those of the round before. Self-loops give components
    of one node.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n_edges = now.count()
    if n_edges <= few:
        now = _in_one_task(now)
    else:
        while True:
            # done when all are stars: no node has two edges down, and none that is another's end has one
            ends = now.select("u", F.lit(1).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("down")).distinct())
            if not ends.groupBy("u").agg(F.sum("down").alias("n"), F.count("*").alias("k")).where("n > 1 OR n = 1 AND k > 1").limit(1).count():
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
            # every larger neighbour goes to the least one
            large = _least_of_hubs(both.where("v > u"), least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # then every node and its smaller neighbours go to the least of them
            small = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            before, now = now, cut(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
            drop(before)
            n_edges = now.count()
    roots = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return roots.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(edges: DataFrame) -> DataFrame:
    """(id, level) of a directed graph (parent, child) without cycles: the longest way down to each node from one without parents, found
    level by level. A cycle is an error."""
    edges = checkpointed(edges.select("parent", "child").distinct())
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("id")).distinct()
    waiting = checkpointed(nodes.join(edges.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
    out, level = None, 0
    while True:
        free = waiting.where("n = 0").select("id")
        if not free.limit(1).count():
            break
        found = free.select("id", F.lit(level).alias("level"))
        out = found if out is None else out.unionByName(found)
        met = edges.join(free.withColumnRenamed("id", "parent"), "parent", "left_semi").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("m"))
        waiting = checkpointed(waiting.where("n > 0").join(met, "id", "left").select("id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")))
        level += 1
    if waiting.limit(1).count():
        raise ValueError("the graph has a cycle")
    return out if out is not None else waiting.select("id", F.lit(0).alias("level"))
