"""SimHash near duplicates by deletion-variant signatures.

A fingerprint of 64 bits has a bit where more than half of the text's shingles have it in their XXH64. Two fingerprints that differ in at
most three bits differ in at most one bit in one of their two halves. So each half is indexed 32 times, each time with another bit as a
wildcard: halves that differ in that bit alone, and equal ones, get the same signature. Signatures are joined on equality, and pairs that meet
are verified by the distance of their whole fingerprints.

Copies and texts with equal fingerprints are one row of that index (``classes``). Nothing emits pairs: what meets in a signature is linked
by as many links as connect it. Of a pair with equal halves only wildcard 0 is asked, of others the bit they differ in.

A signature's group may be crowded: more than CROWD fingerprints share a half. These are counted first (two rows a fingerprint, summed
before the shuffle), and the rows of crowded signatures get finer ones: of the other half's eight nibbles at least five are equal, so each choice
of five of them is a signature (56). Such a group shares 51 of 64 bits and has at most 8192 members; a calm one has at most twice CROWD, which is the same. So a task's group is
bounded whatever the table holds, and no pair is lost.

Nulls and empty texts have no words and the fingerprint 0, which is linked like any other. A text of fewer words than a shingle is one
shingle. Rows without doc_id are left out; rows that share a doc_id have a fingerprint each. Very long texts are hashed in runs of
RUN shingles. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, blocks, clean_docs, discard, runs_of, written
from .graphs import components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Shingles that are taken apart into bits at once.
RUN = 1 << 17
#: Fingerprints that may share a half before its signatures are refined.
CROWD = 4096
#: Crowded signatures that are sent to every task; more are joined by a shuffle.
MOST_SENT = 200_000
#: Copies of a fingerprint from which its component is told by broadcast, at least, and how many such fingerprints there may be.
HOT_COPIES, MOST_HOT = 1000, 100_000
_NIBBLES = [sum(15 << 4 * n for n in five) for five in itertools.combinations(range(8), 5)]


def shingle_bits(data: np.ndarray, offsets: np.ndarray, size: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit integer."""
    n_texts = len(offsets) - 1
    inside = ~SPACE[data]
    starts, ends = runs_of(inside, offsets)
    first = np.searchsorted(starts, offsets)
    # words of a text joined by one space: of each run of white space its first byte stays
    stays = inside.copy()
    stays[1:] |= inside[:-1]
    at = np.concatenate([[0], np.cumsum(stays)])
    joined = np.where(inside, LOWER[data], 32)[stays].astype(np.uint8).tobytes()
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    text = np.repeat(np.arange(n_texts), n)
    word = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    last = np.minimum(word + size, first[1:][text]) - 1
    a, z = at[starts[word]], at[ends[last]]
    counts = np.zeros((n_texts, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(text), RUN):
        hi = min(lo + RUN, len(text))
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a[lo:hi].tolist(), z[lo:hi].tolist())], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(text[lo:hi], prepend=-1))
        counts[text[lo:hi][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document, fp as a signed long."""

    def take(batches):
        for (ids,), data, offsets in blocks(batches):
            yield pa.record_batch([ids, pa.array(shingle_bits(data, offsets).view(np.int64))], ["doc_id", "fp"])

    return clean_docs(docs).mapInArrow(take, "doc_id long, fp long")


def _half(segment: int):
    fp = F.col("fp")
    return F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(0xFFFFFFFF)


def _signature(segment: int, bit: int, half):
    """Half, place of the wildcard and the half's other bits as one long."""
    return half.bitwiseAND(0xFFFFFFFF ^ (1 << bit)).bitwiseOR(F.lit((segment << 37) | (bit << 32)))


def signatures(prints: DataFrame) -> DataFrame:
    """(key, sub, fp): 64 rows for each fingerprint, sub being 0."""
    keys = F.array(*(_signature(s, i, _half(s)) for s in (0, 1) for i in range(32)))
    return prints.select("fp", F.explode(keys).alias("key")).select("key", F.lit(0).cast("long").alias("sub"), "fp")


def crowded_signatures(prints: DataFrame, crowd: int) -> DataFrame:
    """(key) of the signatures that a half of more than crowd fingerprints has."""
    halves = F.array(*(F.struct(F.lit(s).alias("s"), _half(s).alias("half")) for s in (0, 1)))
    many = prints.select(F.explode(halves).alias("h")).groupBy("h.s", "h.half").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    keys = F.when(F.col("s") == 0, F.array(*(_signature(0, i, F.col("half")) for i in range(32)))).otherwise(F.array(*(_signature(1, i, F.col("half")) for i in range(32))))
    return many.select(F.explode(keys).alias("key")).distinct()


def refined(rows: DataFrame) -> DataFrame:
    """Rows of crowded signatures with finer ones: each choice of five nibbles of the half that the signature doesn't hold."""
    other = F.when(F.shiftrightunsigned("key", 37) == 0, _half(1)).otherwise(_half(0))
    subs = F.array(*(other.bitwiseAND(m).bitwiseOR(F.lit((k + 1) << 32)) for k, m in enumerate(_NIBBLES)))
    return rows.select("key", F.explode(subs).alias("sub"), "fp")


def group_links(group: np.ndarray, wild: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked by distance within groups, as a forest: (a, b) places. Rows are sorted by group; wild is the row's signature's place of the
    wildcard as a mask over the fingerprint, 0 where any pair may be linked."""
    n = len(fp)
    label = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, n))
    end = np.repeat(begin + sizes, sizes)
    number = np.repeat(np.arange(len(begin)), sizes)
    active, out, d = np.flatnonzero(end - np.arange(n) > 1), [], 1
    while len(active):
        i = active[label[active] != label[active + d]]
        x = fp[i] ^ fp[i + d]
        i = i[(np.bitwise_count(x) <= distance) & ((wild[i] == 0) | (x & wild[i] != 0))]
        if len(i):
            for p in i.tolist():  # unites what isn't united yet, so no more often than there are rows
                a, b = label[p], label[p + d]
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                if a != b:
                    label[max(a, b)] = min(a, b)
                    out.append((p, p + d))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        d += 1
        active = active[end[active] > active + d]
        if len(active) and (d < 4 or d & (d - 1) == 0):  # groups that are one component are done
            roots = np.bincount(number[label == np.arange(n)], minlength=len(begin))
            active = active[roots[number[active]] > 1]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _search(batches):
    """Links of rows that come sorted by (key, sub, fp); a group that a run of rows breaks off waits for the next one."""

    def links(key, sub, fp):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        alone = new & np.append(new[1:], True)
        group, k, f = np.cumsum(new)[~alone], key[~alone].astype(np.uint64), fp[~alone].view(np.uint64)
        bit = (k >> np.uint64(32)) & np.uint64(31)
        wild = np.where(bit > 0, np.uint64(1) << (bit + (k >> np.uint64(37)) * np.uint64(32)), np.uint64(0))
        a, b = group_links(group, wild, f)
        return pa.record_batch([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        size += batch.num_rows
        if size >= 1 << 18:
            key, sub, fp = (np.concatenate(c) for c in zip(*held))
            last = np.flatnonzero((key == key[-1]) & (sub == sub[-1]))[0]
            if last:
                yield links(key[:last], sub[:last], fp[:last])
            held, size = [[key[last:], sub[last:], fp[last:]]], len(key) - last
    if size:
        yield links(*(np.concatenate(c) for c in zip(*held)))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints that differ in at most DISTANCE bits, as many pairs as connect each component. prints: (fp), distinct."""
    rows = signatures(prints)
    keys = written(crowded_signatures(prints, crowd), "crowded")
    n_crowded = keys.count()
    if n_crowded:
        sent = F.broadcast(keys) if n_crowded <= MOST_SENT else keys
        rows = rows.join(sent, "key", "left_anti").unionByName(refined(rows.join(sent, "key", "left_semi")))
    dealt = rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_search, "a long, b long").distinct()


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    found = written(links(classes.select("fp")), "links")
    part = components(found).withColumnRenamed("id", "fp")
    named = classes.join(part, "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = written(named.join(least, "component").select("fp", "copies", "component_id"), "answers")
    discard(classes, found)
    # documents of a fingerprint with many copies are told their component by broadcast (MOST_HOT rows at most), others by a shuffle
    some = max(HOT_COPIES, -(-prints.count() // MOST_HOT))
    hot, cold = answer.where(F.col("copies") >= some).drop("copies"), answer.where(F.col("copies") < some).drop("copies")
    marked = prints.join(F.broadcast(hot), "fp", "left")
    return marked.where("component_id IS NOT NULL").unionByName(marked.where("component_id IS NULL").drop("component_id").join(cold, "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, the fingerprint as 16 hex digits."""
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
