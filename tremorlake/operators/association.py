"""How likely templates belong to predicted arrivals, given that each explains one of the other at most.

A pair's odds are the likelihood of the template's values under the arrival's models over that under the models of unassociated templates. By itself an arrival chooses
among its templates and a new one (``distribution``). Over a whole catalogue arrivals and templates compete: a state is any set of pairs in which nothing
occurs twice, and its weight the product of their odds. ``marginals`` gives each pair's share of all states by rounds of messages along pairs, which is exact where pairs form trees; components
with loops are summed exactly, arrival by arrival: what earlier choices mean for later ones is which of the templates with pairs on both sides are taken, so states that agree in that are one. Only
components that need more than MOST_STATES of these at once, or have more than MOST_PAIRS pairs, are left to the messages' fixed point.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import band_join
from .lineage import checkpointed
from .matching import edge_components

#: Pairs of a component with loops that one task may sum, and sets of taken templates kept apart in it: at once, and for all pairs together.
MOST_PAIRS, MOST_STATES, MOST_KEPT = 20_000, 1 << 14, 1 << 20


def _log_normal(x: Column, mean, deviation) -> Column:
    z = (x - mean) / deviation
    return -z * z / 2 - F.log(F.lit(1.0) * deviation) - math.log(2 * math.pi) / 2


def association_odds(arrivals: DataFrame, templates: DataFrame, most_seconds: float, rate: float, time_scale: float = 5.0, height: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(id, gid, log_odds): pairs at one station at most most_seconds apart. arrivals: (id, sta, atime, amp, amp_sd), amp being the predicted height of the coda; templates: (gid, sta, ttime,
    coda_height). Residuals of time are Laplacian and of height normal; an unassociated template comes at a rate and has its own mean and deviation of height."""
    pairs = band_join(arrivals.select("id", "sta", "atime", "amp", "amp_sd"), templates.select("gid", "sta", "ttime", "coda_height"), "atime", "ttime", most_seconds, keys=["sta"])
    off = F.abs(F.col("ttime") - F.col("atime"))
    of_event = -off / time_scale - math.log(2 * time_scale) + _log_normal(F.col("coda_height"), F.col("amp"), F.col("amp_sd"))
    alone = math.log(rate) + _log_normal(F.col("coda_height"), F.lit(height[0]), F.lit(height[1]))
    return pairs.select("id", "gid", (of_event - alone).alias("log_odds"))


def distribution(odds: DataFrame, n_templates: DataFrame, rate_seconds: float, smooth: float = 1e-4) -> DataFrame:
    """(id, gid, p): of each arrival the templates it may take, and gid null for a new one. n_templates: (id, n), the unassociated templates at its station, 0 if there
    is none; a new one has the odds P(n) / P(n - 1) of a Poisson count. Probabilities are mixed with a little of equal shares."""
    count = n_templates.select("id", "n")
    new = count.select("id", F.lit(None).cast("long").alias("gid"), F.when(F.col("n") > 0, F.log(F.lit(rate_seconds) / F.col("n"))).otherwise(0.0).alias("log_odds"))
    every = odds.select("id", "gid", "log_odds").unionByName(new)
    top = every.groupBy("id").agg(F.max("log_odds").alias("_top"), F.count("*").alias("_k"))
    shifted = every.join(top, "id").withColumn("_e", F.exp(F.col("log_odds") - F.col("_top")))
    total = shifted.groupBy("id").agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, "id").select("id", "gid", ((F.col("_e") / F.col("_sum") + smooth / F.col("_k")) / (1 + smooth)).alias("p"))


def _log_others(value: Column, node: str, order: str) -> Column:
    """log(1 + sum of exp(value) over a node's other pairs), from sums on either side, so that a large one doesn't swallow the rest."""
    w = Window.partitionBy(node).orderBy(order)
    top = F.greatest(F.max(value).over(Window.partitionBy(node)), F.lit(0.0))
    e = F.exp(value - top)
    before = F.coalesce(F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.coalesce(F.sum(e).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return top + F.log(F.exp(-top) + before + after)


def message_rounds(pairs: DataFrame, tolerance: float = 1e-12, most_rounds: int = 500, cut: int = 4) -> DataFrame:
    """(id, gid, log_odds, p): of each pair the message from its arrival is the log-odds less what else the arrival may take, and so from its template; rounds
    go on until none moves by more than the tolerance. Messages of trees are final after as many rounds as the longest path has pairs."""
    now = checkpointed(pairs.select("id", "gid", "log_odds").withColumns({"a": F.col("log_odds"), "b": F.col("log_odds")}))
    for k in range(1, most_rounds + 1):
        # a: from the arrival to the template, given what templates said; b: back
        after = now.withColumn("a2", F.col("log_odds") - _log_others(F.col("b"), "id", "gid")).withColumn("b2", F.col("log_odds") - _log_others(F.col("a2"), "gid", "id"))
        move = F.greatest(F.abs(F.col("a2") - F.col("a")), F.abs(F.col("b2") - F.col("b")))
        now = after.select("id", "gid", "log_odds", F.col("a2").alias("a"), F.col("b2").alias("b"), move.alias("move"))
        if k % cut == 0:
            now = checkpointed(now)
            if (now.agg(F.max("move")).first()[0] or 0.0) <= tolerance:
                break
    both = F.col("a") + F.col("b") - F.col("log_odds")
    return now.select("id", "gid", "log_odds", (1 / (1 + F.exp(-both))).alias("p"))


def _in_turn(pairs: list[tuple]) -> list[tuple]:
    """Pairs by arrival, the next arrival being one beside what is open that opens the fewest templates."""
    of_id, of_gid = {}, {}
    for pair in pairs:
        of_id.setdefault(pair[0], []).append(pair)
        of_gid.setdefault(pair[1], []).append(pair[0])
    left, known, beside, out = dict(of_id), set(), set(), []
    while left:
        new = lambda i: (sum(g not in known for _, g, _ in of_id[i]), len(of_id[i]), i)
        i = min(beside or left, key=new)
        out += left.pop(i)
        known |= {g for _, g, _ in of_id[i]}
        beside = (beside | {o for _, g, _ in of_id[i] for o in of_gid[g]}) & left.keys()
    return out


def _sums(log: dict, key: int, value: float) -> None:
    old = log.get(key)
    log[key] = value if old is None else max(old, value) + math.log1p(math.exp(-abs(old - value)))


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """Marginals of one component by all its states, null where they are too many. A state up to a pair is told by the sides taken that have pairs to come."""
    pairs = _in_turn(sorted(part[["id", "gid", "log_odds"]].itertuples(index=False, name=None)))
    last, bit, free, most = {}, {}, [], 0
    for k, (i, g, _) in enumerate(pairs):
        last["i", i] = last["g", g] = k
    steps = []
    for k, (i, g, w) in enumerate(pairs):
        sides = ("i", i), ("g", g)
        for side in sides:
            if side not in bit:
                if not free:
                    free.append(most)
                    most += 1
                bit[side] = free.pop()
        both = 1 << bit[sides[0]] | 1 << bit[sides[1]]
        done = [s for s in sides if last[s] == k]
        steps.append((both, ~sum(1 << bit[s] for s in done), w))
        free += [bit.pop(s) for s in done]
    forward, kept = [{0: 0.0}], 1
    for both, stay, w in steps:
        after: dict[int, float] = {}
        for taken, v in forward[-1].items():
            _sums(after, taken & stay, v)
            if not taken & both:
                _sums(after, (taken | both) & stay, v + w)
        kept += len(after)
        if len(after) > MOST_STATES or kept > MOST_KEPT:
            return part[["id", "gid", "log_odds"]].assign(p=None)
        forward.append(after)
    z, back, p = forward[-1][0], {0: 0.0}, [0.0] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        both, stay, w = steps[k]
        before: dict[int, float] = {}
        for taken, v in forward[k].items():
            ahead = back[taken & stay]
            if not taken & both:
                with_pair = back[(taken | both) & stay] + w
                p[k] += math.exp(v + with_pair - z)
                ahead = max(ahead, with_pair) + math.log1p(math.exp(-abs(ahead - with_pair)))
            before[taken] = ahead
        back = before
    return pd.DataFrame(pairs, columns=["id", "gid", "log_odds"]).assign(p=p)


def marginals(pairs: DataFrame) -> DataFrame:
    """(id, gid, log_odds, p) of every pair (id, gid, log_odds) of an arrival and a template."""
    pairs = checkpointed(pairs.select("id", "gid", "log_odds"))
    alone = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    single = pairs.join(alone("id"), "id", "left_semi").join(alone("gid"), "gid", "left_semi").select("id", "gid", "log_odds")
    rest = checkpointed(edge_components(pairs.join(single.select("id", "gid"), ["id", "gid"], "left_anti")))
    sizes = rest.groupBy("comp").agg(F.count("*").alias("n_pairs"), F.count_distinct("id").alias("n_id"), F.count_distinct("gid").alias("n_gid"))
    loops = sizes.where((F.col("n_pairs") >= F.col("n_id") + F.col("n_gid")) & (F.col("n_pairs") <= MOST_PAIRS)).select("comp")
    summed = checkpointed(rest.join(loops, "comp", "left_semi").groupBy("comp").applyInPandas(_summed, "id long, gid long, log_odds double, p double"))
    sent = message_rounds(rest.join(loops, "comp", "left_anti").select("id", "gid", "log_odds").unionByName(summed.where("p IS NULL").drop("p")))
    return single.select("id", "gid", "log_odds", (1 / (1 + F.exp(-F.col("log_odds")))).alias("p")).unionByName(summed.where("p IS NOT NULL")).unionByName(sent)
