"""Near duplicates by an exact Jaccard join of word 5-gram sets, searched by T-occurrence with DivideSkip.

1. Documents with equal sets form a class (by size and 128 bits of their sets' sums), whose number is its node.
2. Shingles have one global order: those of few documents first. Two sets that link share s of their first
   n - ceil(0.75 n) + s shingles in that order, where s is a tenth of the smaller size (SHARED at least, or all that small
   sets need), so lists of these shingles name all candidates. Classes are tied if s short lists (of at most SHORT
   classes) hold both. Two that link and are not tied so are on one long list. Classes on long lists take ROUNDS more turns, by an order that
   has all shingles with long lists so far last, as a larger corpus has many that no block shows to be frequent. What is on long lists then
   makes stars: first n - ceil(0.75 n) + 1 shingles only where it is known to be frequent, as the first shingle that two linked sets have in common is
   one of these, or else they share a short list and frequent ones to make up for the rest of s. A star ties two classes if
   their sizes, or those of a chain of classes between them, allow a link. Components of ties are candidate groups, and no link leaves a group.
   A class has at most SHORT partners on a short list; long lists are read as a stream. Lists of VERY_LONG classes or more are not made:
   their members are tied to a node of their shingle and size, and these nodes to each other.
3. In a group the sets' inverted lists are searched: a query has to meet T of its lists; its L longest lists are put
   aside, the short ones are merged, documents with T - L hits are probed in the long ones by binary search. Links are
   decided on exact counts. A group is split into blocks of about BLOCK classes, in groups of more than WIDE_GROUP of more, by the root of its size: first all blocks meet the first one,
   then whatever isn't in the group's largest component meets all blocks. Classes that are connected already
   needn't meet, so large groups of near copies cost little, and no link between components is missed. A group whose members
   seldom link costs a search of every block in every other one.

A null text is an empty one; texts of any length are whole. Documents without words have empty sets and link with nothing. Those
with fewer than WORDS words have one shingle. Rows are told apart by their text: rows that share a doc_id and not the text
are documents of their own, repeated rows get the same values. Empty tables give empty results. The table of frequent shingles
holds MOST_HOT entries at most and only orders the lists; results don't depend on it. Classes of many copies are dealt by
broadcast (MOST_HOT_CLASSES at most), the others by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, RunHasher, blocks, discard, mix, ragged, span_hashes, words_of, written
from .graphs import components
from .repeats import by_key, by_text

WORDS = 5
#: Links need an intersection of PER_CENT / 100 of the union.
PER_CENT = 75
MOST_HOT = 400_000
HOT_IN_BLOCK, HOT_AT_ALL = 2, 6
SURVEY_BYTES = 8 << 20
#: Bytes of texts whose sets are made at once.
SETS_BYTES = 1 << 19
#: Classes of a list that isn't made; rows of sorted lists that a worker holds; copies in a class that is dealt by broadcast,
#: at least, and how many such classes there may be.
VERY_LONG, LIST_ROWS, HOT_COPIES, MOST_HOT_CLASSES = 500_000, 150_000, 200, 100_000
#: Documents of a short list; what two sets share at least of their longer prefixes: SHARED or a part of their size.
SHORT, SHARED, SHARED_PART = 64, 4, 10
#: Turns that classes on long lists take with these lists' shingles last.
ROUNDS = 3
BLOCK, WIDE_GROUP = 100, 1000
#: Counts as enough shared shingles.
ALWAYS = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the bounds of the texts. A few texts of SETS_BYTES, or one longer one, take turns:
    hashing words needs fifty times their bytes."""
    hasher, parts, sizes, i = RunHasher(), [], [np.zeros(1, np.int64)], 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SETS_BYTES, "right")) - 1)
        values, bounds = _few_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
        parts.append(values)
        sizes.append(np.diff(bounds))
        i = j
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum(np.concatenate(sizes))


def _few_sets(data: np.ndarray, offsets: np.ndarray, hasher: RunHasher) -> tuple[np.ndarray, np.ndarray]:
    _, _, codes, first = words_of(LOWER[data], offsets, ~SPACE, hasher)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    grams = mix(span_hashes(codes, WORDS))
    at = np.flatnonzero(np.arange(len(grams)) + WORDS <= first[1:][text[: len(grams)]])
    values, owner = [grams[at]], [text[at]]
    for k in range(1, WORDS):
        short = np.flatnonzero(n == k)
        if len(short):
            with np.errstate(over="ignore"):
                values.append(mix(mix(span_hashes(codes, k)[first[short]]) + np.uint64(k)))
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort([values, owner])
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _class_hash(n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """64 bits of a class; classes that have them in common share candidates, no more."""
    with np.errstate(over="ignore"):
        return mix(one.view(np.uint64) + mix(two.view(np.uint64) + n.astype(np.uint64))).view(np.int64)


def _survey(batches):
    """A row for each document: its text's row hash, its class (hash, size and sums of the set); and one for each shingle that is
    frequent in a block."""
    for (ids, rows), data, offsets in blocks(batches, ("doc_id", "row"), SURVEY_BYTES):
        values, bounds = shingle_sets(data, offsets)
        token, n = np.unique(values, return_counts=True)
        hot = n >= HOT_IN_BLOCK
        none, token = np.zeros(int(hot.sum()), np.int64), token[hot].view(np.int64)
        size, one, two = np.diff(bounds), _sums(values, bounds, 1), _sums(values, bounds, 2)
        both = lambda x, y: pa.array(np.concatenate([x, y]))
        yield pa.record_batch(
            [pa.concat_arrays([c, pa.nulls(len(none), pa.int64())]) for c in (ids, rows)] + [both(_class_hash(size, one, two), none), both(size, n[hot]), both(one, token), both(two, none)],
            ["doc_id", "row", "h", "n", "one", "two"],
        )


def shared_at_least(n: np.ndarray) -> np.ndarray:
    """How many of the prefixes' shingles a set of n shares with any set that it links with."""
    return np.minimum(np.maximum(SHARED, -(-n // SHARED_PART)), -(-PER_CENT * n // 100))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-PER_CENT * n // 100) + shared_at_least(n)


def first_common_within(n: np.ndarray) -> np.ndarray:
    """The first shingle that a set of n has in common with one that it links with is one of so many first ones."""
    return n - -(-PER_CENT * n // 100) + 1


def prefix_order(values: np.ndarray, bounds: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of the shingles, text by text, in the global order: rare ones by hash, then frequent ones by rank."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.zeros(len(values), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        place = np.where(hot[at] == values, rank[at] + 1, 0)
    return np.lexsort([values, place, owner])


def t_occurrence(lists: list[np.ndarray], least: int, weight: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Documents on ``least`` lists or more, and on how many, by DivideSkip; lists are sorted."""
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(len(lists) - 1, least - 1, int(least / (weight * np.log2(longest + 1) + 1)))
    aside = max(0, aside) if longest > 8 else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if not short:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    merged = np.sort(np.concatenate(short), kind="stable")  # merges the sorted lists run by run
    at = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])[: len(merged)])
    count = np.diff(np.append(at, len(merged)))
    enough = count >= max(1, least - aside)
    docs, count = merged[at[enough]], count[enough]
    for k, x in enumerate(long):
        if not len(docs):
            break
        at = np.minimum(np.searchsorted(x, docs), len(x) - 1)
        count = count + (x[at] == docs)
        alive = count >= least - (len(long) - 1 - k)
        docs, count = docs[alive], count[alive]
    return docs, count


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of its component of linked sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    token, of = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(m), sizes)
    order = np.argsort(of, kind="stable")
    posting, start = doc[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(token)))])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parent, left = np.arange(m), m
    for q in np.argsort(-sizes, kind="stable").tolist():
        if left == 1:
            break
        n = int(sizes[q])
        if not n:
            continue
        mine = of[bounds[q] : bounds[q + 1]]
        docs, count = t_occurrence([posting[start[t] : start[t + 1]] for t in mine], -(-PER_CENT * n // 100))
        ok = 100 * count >= PER_CENT * (n + sizes[docs] - count)
        for d in docs[ok].tolist():
            a, b = _root(parent, q), _root(parent, d)
            if a != b:
                parent[a] = b
                left -= 1
    return np.array([_root(parent, i) for i in range(m)])


def _pairs_of_short(start: np.ndarray, size: np.ndarray, doc: np.ndarray, n: np.ndarray):
    """All pairs on lists of at most SHORT documents whose sizes allow a link."""
    for k in range(2, SHORT + 1):
        lists = start[size == k]
        if len(lists):
            x, y = np.triu_indices(k, 1)
            i, j = (lists[:, None] + x).ravel(), (lists[:, None] + y).ravel()  # n ascends within a list
            ok = 100 * n[i] >= PER_CENT * n[j]
            yield i[ok], j[ok]


def _whole_lists(batches, final):
    """(table, key that goes on from the table before, or None) of sorted (token, h, n, more), whole lists as far as LIST_ROWS rows; a
    longer one comes in parts, each opened by the first and the last row of the one before. In the final turn only rows of stars are left in parts."""
    held, size, on = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < LIST_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut), on
            rest, on = table.slice(cut), None
        else:
            if final:
                table = table.filter(pa.array((table.column("more").to_numpy() & 1) > 0))
            yield table, int(keys[0])
            rest, on = table.take(pa.array([0, table.num_rows - 1] if table.num_rows else [], pa.int64())), int(keys[0])
        held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held), on


def _ties(final):
    """(a, b, shared, needed): classes on common short lists. Rows on long lists are given as (token, class, -1, size), but in the final turn their stars'
    ties: each class with the smallest one that its size allows to link with, and those with the one before them. more: twice the number of frequent shingles
    in the class's prefix, and 1 if the row makes stars."""

    def narrow(batches, wide):
        for batch in batches:
            mask = batch.column("wide").to_numpy(zero_copy_only=False)
            if mask.any():
                wide.append(batch.filter(pa.array(mask)))
                batch = batch.filter(pa.array(~mask))
            yield batch

    def rows(one, two, shared, needed):
        return pa.record_batch([pa.array(one), pa.array(two), pa.array(shared.astype(np.int32)), pa.array(needed.astype(np.int32))], ["a", "b", "shared", "needed"])

    def listed(token, doc, n):
        return rows(token, doc, np.full(len(doc), -1), n)

    def run(batches):
        wide: list = []
        for table, on in _whole_lists(narrow(batches, wide), final):
            yield from (listed(*(w.column(c).to_numpy() for c in ("token", "h", "n"))) for w in wide)
            wide.clear()
            token, doc, n, more = (table.column(c).to_numpy() for c in ("token", "h", "n", "more"))
            order = np.lexsort([doc, n, token])
            order = order[np.append(True, (token[order[1:]] != token[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]))[: len(order)]]  # copies are one
            token, doc, n, more = token[order], doc[order], n[order].astype(np.int64), more[order]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            size = np.diff(np.append(start, len(token)))
            rows_of = size.copy()
            if on is not None and len(token):
                size[token[start] == on] += SHORT  # part of a long list
            long = np.repeat(size > SHORT, rows_of)
            found = list(_pairs_of_short(start, size, doc, n))
            a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            needed = np.minimum(shared_at_least(n[a]), shared_at_least(n[b]))
            if final:
                needed = np.maximum(1, needed - np.minimum(more[a] >> 1, more[b] >> 1))
            one, two = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            by = np.lexsort([two, one])
            one, two, needed = one[by], two[by], needed[by]
            new = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)])
            yield rows(one[new], two[new], np.diff(np.append(new, len(one))), needed[new])
            if not final:
                yield listed(token[long], doc[long], n[long])
                continue
            long &= (more & 1) > 0
            ldoc, ln, ltoken = doc[long], n[long], token[long]
            if len(ldoc):
                step = (ltoken[1:] == ltoken[:-1]) & (100 * ln[:-1] >= PER_CENT * ln[1:])
                head = np.flatnonzero(np.append(True, ~step))[np.cumsum(np.append(True, ~step)) - 1]
                star = 100 * ln[head[1:]] >= PER_CENT * ln[1:]
                at = np.flatnonzero(step)
                other = np.where(star[at], head[1:][at], at)
                pairs = np.unique(np.stack([np.minimum(ldoc[other], ldoc[at + 1]), np.maximum(ldoc[other], ldoc[at + 1])], axis=1), axis=0)
                yield rows(pairs[:, 0], pairs[:, 1], np.full(len(pairs), ALWAYS), np.ones(len(pairs), np.int64))
        yield from (listed(*(w.column(c).to_numpy() for c in ("token", "h", "n"))) for w in wide)

    return run


def _meet(rows: DataFrame) -> DataFrame:
    """(a, b): each class of a task and the least one it is connected with there; rows: node, h, text, tasks array<long>. Of
    a doc_id's texts only that of the class is taken, once in a block."""

    def deal(batches):
        for (ids, h, tasks), data, offsets in blocks(batches, ("node", "h", "tasks")):
            values, bounds = shingle_sets(data, offsets)
            mine = np.flatnonzero(_class_hash(np.diff(bounds), _sums(values, bounds, 1), _sums(values, bounds, 2)) == h.to_numpy())
            mine = mine[np.unique(ids.to_numpy()[mine], return_index=True)[1]]
            tasks, ids = tasks.take(pa.array(mine)), ids.take(pa.array(mine))
            sets = pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in mine.tolist()], pa.binary())
            at, flat = pa.array(np.repeat(np.arange(len(ids)), np.asarray(tasks.value_lengths()))), tasks.flatten()
            for i in range(0, len(at), 500):
                part = at.slice(i, 500)
                yield pa.record_batch([flat.slice(i, 500), ids.take(part), sets.take(part)], ["task", "node", "shingles"])

    def search(batches):
        for table in by_key(batches, 2000):
            task, node = table.column("task").to_numpy(), table.column("node").to_numpy()
            sets = table.column("shingles").to_pylist()
            a, b = [], []
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            for x, y in zip(starts.tolist(), np.append(starts[1:], len(task)).tolist()):
                if y - x > 1:
                    of = linked_sets([np.frombuffer(s, np.uint64) for s in sets[x:y]])
                    least = np.full(y - x, np.iinfo(np.int64).max)
                    np.minimum.at(least, of, node[x:y])
                    other = least[of] != node[x:y]
                    a.append(node[x:y][other]), b.append(least[of][other])
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(np.concatenate(none + a)), pa.array(np.concatenate(none + b))], ["a", "b"])

    return rows.mapInArrow(deal, "task long, node long, shingles binary").repartition("task").sortWithinPartitions("task").mapInArrow(search, "a long, b long")


def _frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_HOT frequent shingles in ascending order, and in how many documents each is."""
    top = survey.where("doc_id IS NULL").groupBy("one").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_AT_ALL).orderBy(F.desc("n"), "one").limit(MOST_HOT).toPandas()
    token = top["one"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def _with_lists(token: np.ndarray, n: np.ndarray, known: np.ndarray, met: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent shingles, how many documents each is in, and whether it is known for a long list, with the long lists of met; MOST_HOT of all at most."""
    top = met.where("shared < 0").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).orderBy(F.desc("n"), "a").limit(MOST_HOT).toPandas()
    every = np.concatenate([token, top["a"].to_numpy(np.int64).view(np.uint64)])
    token, at = np.unique(every, return_inverse=True)
    most, long = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    np.maximum.at(most, at, np.concatenate([n, top["n"].to_numpy(np.int64)]))
    np.logical_or.at(long, at, np.concatenate([known, np.ones(len(top), bool)]))
    best = np.sort(np.lexsort([token, -most])[:MOST_HOT])
    return token[best], most[best], long[best]


def _met(texts: DataFrame, table: tuple, copies: tuple, final: bool) -> DataFrame:
    """What _ties gives for the lists of all texts' prefixes, by the order of table (shingles, documents of each, whether known for a long list)."""
    token, n_docs, known = table
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort([token, n_docs])] = np.arange(1, len(token) + 1)  # the most frequent one last
    very = n_docs >= VERY_LONG
    shared = texts.sparkSession.sparkContext.broadcast((token, rank, known | very, very, *copies))

    def prefixes(batches):
        tokens, rank, known, very, hot_h, hot_doc = shared.value
        for (ids,), data, offsets in blocks(batches):
            values, bounds = shingle_sets(data, offsets)
            n, ids = np.diff(bounds), np.asarray(ids)
            h = _class_hash(n, _sums(values, bounds, 1), _sums(values, bounds, 2))
            pick = np.zeros(len(n), bool)
            pick[np.unique(h, return_index=True)[1]] = True  # of equal sets in a block one is enough
            if len(hot_h):  # and of those with many copies one in all
                k = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                hot = hot_h[k] == h
                pick = np.where(hot, ids == hot_doc[k], pick)
            pick &= n > 0
            where = prefix_order(values, bounds, tokens, rank)
            size, n = prefix_length(n)[pick], n[pick]
            token = values[where[ragged(bounds[:-1][pick], size)]]
            k = np.minimum(np.searchsorted(tokens, token), max(0, len(tokens) - 1))
            is_known, wide = ((tokens[k] == token) & x[k] if len(tokens) else np.zeros(len(token), bool) for x in (known, very))
            owner = np.repeat(np.arange(len(size)), size)
            more = np.zeros(len(token), np.int32)
            if final:
                stars = ~is_known | (ragged(np.zeros(len(size), np.int64), size) < first_common_within(n)[owner])
                more = (2 * np.bincount(owner, is_known, len(size)).astype(np.int32)[owner] + stars).astype(np.int32)
                took = ~wide | stars
                token, owner, more, wide = token[took], owner[took], more[took], wide[took]
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(h[pick][owner]), pa.array(n[owner].astype(np.int32)), pa.array(more), pa.array(wide)], ["token", "h", "n", "more", "wide"])

    rows = texts.select("doc_id", "text").mapInArrow(prefixes, "token long, h long, n int, more int, wide boolean")
    rows = rows.repartition(F.when(F.col("wide"), F.xxhash64("token", "h")).otherwise(F.col("token")) if very.any() else "token")
    return written(rows.sortWithinPartitions("token", "n").mapInArrow(_ties(final), "a long, b long, shared int, needed int").where("a <> b OR shared < 0"), "met")


def _candidates(texts: DataFrame, survey: DataFrame, classes: DataFrame, hot_classes: DataFrame) -> DataFrame:
    """(a, b): nodes that are tied, directly or by nodes (below zero) of a very common shingle and a size."""
    token, n_docs = _frequent(survey)
    table = token, n_docs, np.zeros(len(token), bool)
    hot = hot_classes.select("h", "doc_id").toPandas().sort_values("h")  # MOST_HOT_CLASSES at most
    copies = hot["h"].to_numpy(np.int64), hot["doc_id"].to_numpy(np.int64)
    ids, parts, hard, turn = classes.select("h", "doc_id"), [], None, 0
    while True:
        met = _met(texts if hard is None else hard, table, copies, turn == ROUNDS)
        common = met.where("shared >= 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"))
        parts.append(written(common.where("shared >= needed").select("a", "b"), "tied"))
        if turn == ROUNDS:
            break
        # classes on long lists take another turn, one document each
        again = ids.join(met.where("shared < 0").select(F.col("b").alias("h")).distinct(), "h", "left_semi").select("doc_id").distinct()
        n_again = again.count()
        if not n_again:
            break
        n_known = int(table[2].sum())
        table = _with_lists(*table, met)
        if hard is None or 2 * n_again < n_hard:
            every = texts if hard is None else hard
            left, n_hard = hard, n_again
            hard = written(every.join(F.broadcast(again) if n_again <= MOST_HOT else again, "doc_id", "left_semi").select("doc_id", "text"), "hard")
            discard(*([left] if left is not None else []))
        discard(met)
        turn = turn + 1 if int(table[2].sum()) > n_known else ROUNDS  # another turn by the same order finds the same
    node = classes.select("h", "node")
    tied = parts[0]
    for part in parts[1:]:
        tied = tied.unionByName(part)
    ties = tied.join(node.toDF("a", "na"), "a").join(node.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = classes.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")  # a hash of several classes
    ties = ties.unionByName(classes.select("h", "node").join(same.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), "b"))
    if (table[1] >= VERY_LONG).any():
        hub = lambda n: -1 - F.shiftrightunsigned(F.xxhash64("token", n), 1)
        wide = met.where("shared < 0").select(F.col("a").alias("token"), F.col("needed").alias("n"), F.col("b").alias("h")).distinct()
        members = wide.join(node, "h").select(F.col("node").alias("a"), hub("n").alias("b"))
        before = F.lag("n").over(Window.partitionBy("token").orderBy("n"))  # a row for each size of such a shingle's sets
        chain = wide.select("token", "n").distinct().withColumn("m", before).where(100 * F.col("m") >= PER_CENT * F.col("n")).select(hub("m").alias("a"), hub("n").alias("b"))
        ties = ties.unionByName(members).unionByName(chain)
    out = written(ties.where("a <> b").distinct(), "ties")
    discard(met, *parts, *([hard] if hard is not None else []))
    return out


def _links(texts: DataFrame, classes: DataFrame, ties: DataFrame) -> DataFrame:
    """(a, b): nodes of linked classes, as many as connect each component."""
    wide = lambda m: BLOCK * F.greatest(F.lit(1.0), F.sqrt(m / WIDE_GROUP))
    groups = written(components(ties).where("id >= 0").withColumnRenamed("component", "grp"), "groups")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / wide(F.count("*"))).cast("long").alias("n_blocks"))
    placed = groups.join(sizes, "grp").select(F.col("id").alias("node"), "grp", "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block"))
    placed = placed.join(classes.select("node", "h", "doc_id"), "node")
    grouped = written(texts.join(placed, "doc_id").select("node", "h", "text", "grp", "n_blocks", "block"), "grouped")

    # first every block meets block 0
    first = F.when(F.col("block") == 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda j: F.xxhash64("grp", j))).otherwise(F.array(F.xxhash64("grp", "block")))
    links = written(_meet(grouped.select("node", "h", "text", first.alias("tasks"))), "links")

    # then what isn't in the largest component of a group of several blocks meets all blocks
    several = grouped.where("n_blocks > 1").select("node", "grp", "n_blocks", "block").distinct()
    if several.limit(1).count():
        label = several.join(components(links).withColumnRenamed("id", "node"), "node", "left").select("node", "grp", "n_blocks", "block", F.coalesce("component", "node").alias("component"))
        label = written(label, "labels")
        counts = label.groupBy("grp", "component").agg(F.count("*").alias("k"))
        largest = written(counts.groupBy("grp").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("m"), F.max("k").alias("k")).where("m > k").select("grp", "largest", F.ceil((F.col("m") - F.col("k")) / wide(F.col("m"))).cast("long").alias("n_rest")), "largest")
        todo = label.join(largest, "grp")
        rest = F.col("component") != F.col("largest")
        ranges = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_rest"))
        tasks = F.array_distinct(F.concat(F.transform(ranges("n_rest"), lambda i: F.xxhash64("grp", i, "block", F.lit(1))), F.when(rest, F.transform(ranges("n_blocks"), lambda j: F.xxhash64("grp", own, j, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))))
        more = todo.select("node", tasks.alias("tasks"))
        links = links.unionByName(written(_meet(grouped.join(more, "node").select("node", "h", "text", "tasks")), "links"))
    links = written(components(links), "components")
    discard(groups, grouped, ties)
    return links


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component) of every document: a hash of its text as row, and the component's number, which
    components of one smallest doc_id don't share; null without words."""
    texts = by_text(docs)
    survey = written(texts.mapInArrow(_survey, "doc_id long, row long, h long, n long, one long, two long"), "survey")
    sets = survey.where("doc_id IS NOT NULL")
    key = ["one", "two", "n"]
    some = max(HOT_COPIES, -(-sets.count() // MOST_HOT_CLASSES))
    classes = sets.where("n > 0").groupBy(*key).agg(F.min("h").alias("h"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    label = _links(texts, classes, _candidates(texts, survey, classes, classes.where(F.col("copies") >= some)))

    named = label.withColumnRenamed("id", "node").join(classes.select("node", "doc_id"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.select("node", "component").join(least, "component")
    result = written(classes.join(of, "node", "left").select(*key, "copies", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("component")), "labels")
    # copies of a class with many are told their component by broadcast (MOST_HOT_CLASSES rows at most), others by a shuffle
    names = ["doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "component"]
    hot, cold = result.where(F.col("copies") >= some).drop("copies"), result.where(F.col("copies") < some).drop("copies")
    rows = sets.where("n > 0").join(F.broadcast(hot), key, "left")
    out = rows.where("component_id IS NOT NULL").select(*names).unionByName(rows.where("component_id IS NULL").drop("component_id", "component").join(cold, key).select(*names))
    return out.unionByName(sets.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row of its smallest doc_id stays (of several texts with
    that doc_id the one of the least hash), with its columns as they are. Rows without doc_id go."""
    found = written(labelled(docs).where("doc_id = component_id"), "stays")
    with_words = found.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    stays = with_words.drop("component").unionByName(found.where("n_shingles = 0").select("doc_id", "row").distinct())
    names = docs.columns
    held = docs.where("doc_id IS NOT NULL").select(F.struct(*names).alias("held"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    kept = held.join(stays, ["doc_id", "row"], "left_semi")
    repeated = found.groupBy("doc_id", "row").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "row")
    if repeated.limit(1).count():  # repeated rows, one of which is enough
        kept = kept.join(repeated, ["doc_id", "row"], "left_anti").select("held").unionByName(kept.join(repeated, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.first("held").alias("held")).select("held"))
    return kept.select("held.*")
