"""How five filters act on a corpus in every order, from a histogram of failure masks.

Native expressions give each document a mask of the filters that it fails:

    A (1)   fewer than 200 words
    B (2)   fewer than half of its words are distinct
    C (4)   more than 2 % of its code points are A-Z
    D (8)   it holds any of # $ % & * |
    E (16)  a smaller doc_id anywhere in the table has the same text

A-D need the text alone and are found in the only pass over it, whose small rows (part, mask, labels, the text's SHA-256) are written once.
Grouping them by that key gives the smallest doc_id of each text; a join by (doc_id, key), whose rows are nearly unique, marks those
rows, so that no text, however often it is copied, gathers in one task. Then each part has at most 32 cells (mask, counts), and
all 120 orders of the filters are read off the cells: a filter removes, of what the earlier ones in its order leave, the masks that
hold its bit.

Nulls: a null text is an empty one, which fails A alone and, but for the smallest doc_id of empty texts, E; a null source is the part ''. Rows without doc_id are
left out. Rows that share a doc_id count each; repeated rows are no smaller doc_id than one another, so they don't fail E by themselves.
A document is good (toxic) if any of its rows in labels says 1; labels without doc_id and other values count for nothing. A text's
words are held together in one array while it is looked at, so memory grows with the longest text (about 100 bytes a word).
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_SPACES = "\t\n\x0b\x0c\r "
_SPACE_RUN = r"[\x20\x09-\x0D]+"


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, key, mask) of every row: the bits of A-D, which a text alone decides, and its SHA-256."""
    text = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = text.withColumn("inner", F.trim("text", F.lit(_SPACES)))
    split = trimmed.withColumn("words", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", _SPACE_RUN)))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    counted = split.select("doc_id", "part", F.sha2("text", 256).alias("key"), F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.length("text").cast("long").alias("n_chars"), capitals.cast("long").alias("n_capitals"), F.rlike("text", F.lit("[#$%&*|]")).alias("symbols"))
    fails = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), 100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"), F.col("symbols")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return counted.select("doc_id", "part", "key", mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, at most 32 rows a part."""
    label = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = written(masks(docs).join(label, "doc_id", "left"), "masks")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["doc_id", "key"], "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return marked.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), count("good"), count("toxic"))


def orders() -> list[dict]:
    """Each step of each order: the filter's bit and the bits of those before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, at in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "bit": 1 << at, "before": sum(1 << i for i in order[:k])})
    return out


def audit(found: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    n_orders = len(orders()) // len(FILTERS)
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, bit int, before int>>")
    part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    rows = part.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")

    def total(value, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(holds(c["mask"]), value(c)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    reaches = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & reaches(m)
    n = lambda c: c["n"]
    # of the orders of its failing filters, a document is removed first by each of them in an equal share
    share = lambda c: (c["n"] * n_orders / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: reaches(m) & ~fails(m)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: fails(m) & ~reaches(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of whole documents."""
    return audit(cells(docs, labels))
