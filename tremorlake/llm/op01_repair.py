"""Token-id files compressed by Re-Pair grammars.

Documents are sorted by doc_id over shards (one per task, of about SHARD_BYTES of text at most). A shard is a row of blocks of about
BLOCK_TOKENS ids. In each block the most frequent pairs of neighbouring symbols become nonterminals, up to RULES_PER_ROUND of them at
once, again and again until no pair occurs LEAST_COUNT times (a rule for a rarer pair takes more bytes than it saves), never across
documents. A block's row in the Parquet file holds the rules, each rule's expansion length, the remaining symbols
and the documents' counts, so that any range of ids decodes without the rest (``read_range``).

Null and empty texts give just the end id. A text longer than a block makes a block of its own. Rows with the same
doc_id stay apart, in the order of their texts. An empty table writes no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, clean_docs
from .tokens import encoder

BLOCK_TOKENS = 1 << 20
SHARD_BYTES = 256 << 20
RULES_PER_ROUND = 4096
LEAST_COUNT = 6
_BINS = 20

BLOCK_SCHEMA = "shard int, block int, n_ids long, n_terminals int, doc_ids array<long>, doc_tokens binary, rules binary, round_sizes array<int>, expansions binary, symbols binary"


def _distinct(code: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, for each place the number of its pair, and how often each is there. Slots that hold one pair only need no sorting."""
    if slot is None:
        return np.unique(code, return_inverse=True, return_counts=True)
    holds, mixed, number = np.zeros(1 << _BINS, np.int64), np.zeros(1 << _BINS, bool), np.full(1 << _BINS, -1, np.int32)
    holds[slot] = code
    mixed[slot[holds[slot] != code]] = True
    several = mixed[slot]
    one = slot[~several]
    number[one] = 0
    slots = np.flatnonzero(number == 0)
    number[slots] = np.arange(len(slots))
    pairs, of, n = np.unique(code[several], return_inverse=True, return_counts=True)
    out = np.empty(len(code), np.int64)
    out[~several], out[several] = number[one], of + len(slots)
    return np.concatenate([holds[slots], pairs]), out, np.concatenate([np.bincount(number[one], minlength=len(slots)), n])


def _frequent_pairs(code: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs at some places the most frequent ones, and for each place the number of its pair or -1."""
    pairs, of, n = _distinct(code, slot)
    top = np.lexsort([pairs, -n])[:RULES_PER_ROUND]
    top = top[n[top] >= LEAST_COUNT]
    top = top[np.argsort(pairs[top])]
    rule_of = np.full(len(pairs), -1)
    rule_of[top] = np.arange(len(top))
    return pairs[top], rule_of[of]


def _places_of_frequent_pairs(seq: np.ndarray, last: np.ndarray):
    """Places that the most frequent pairs of the whole sequence are among, by the sums of hash slots; then those of all slots that are
    heavy enough, if many rare pairs in common slots hid every frequent one."""
    code = (seq[:-1] << 32) | seq[1:]
    with np.errstate(over="ignore"):
        slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).astype(np.int64)
    slot[last[:-1]] = 1 << _BINS
    heavy = np.bincount(slot, minlength=(1 << _BINS) + 1)
    heavy[1 << _BINS] = 0
    more = np.cumsum(np.bincount(heavy)[::-1])[::-1]  # slots of so many pairs or more
    heaviest = int(np.searchsorted(-more, -RULES_PER_ROUND, "right")) - 1
    for bound in sorted({max(LEAST_COUNT, heaviest), LEAST_COUNT}, reverse=True):
        at = np.flatnonzero(heavy[slot] >= bound)
        yield at, code[at], slot[at], bound == LEAST_COUNT


def build_grammar(ids: np.ndarray, counts: np.ndarray) -> dict:
    """Rules (left, right), rules made in each round, expansion lengths and what is left of the ids.

    A round that replaces all frequent pairs leaves none but those that hold a new nonterminal, so that the rounds after it
    look at those places alone.
    """
    n_terminals = int(ids.max()) + 1 if len(ids) else 1
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    lefts, rights, sizes = [], [], []
    lengths = np.ones(n_terminals, np.int64)
    near = None  # places of pairs with a nonterminal of the last round, where no other pair can be frequent
    while len(seq) > 1:
        if near is not None:
            places = [(near, (seq[near] << 32) | seq[near + 1], None, True)]
        else:
            places = _places_of_frequent_pairs(seq, last)
        for at, code, slot, whole in places:
            pairs, hit = _frequent_pairs(code, slot)
            if len(pairs):
                break
        if not len(pairs):
            break
        whole = whole and len(pairs) < RULES_PER_ROUND
        at, hit = at[hit >= 0], hit[hit >= 0]
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of neighbouring hits every second one is replaced
        odd = (np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 1
        at, hit = at[~odd], hit[~odd]
        used, hit = np.unique(hit, return_inverse=True)
        left, right = pairs[used] >> 32, pairs[used] & 0xFFFFFFFF
        seq[at] = len(lengths) + hit
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        near = None
        if whole:
            made = at - np.arange(len(at))  # where the new nonterminals are now
            near = np.unique(np.concatenate([made - 1, made]))
            near = near[(near >= 0) & (near < len(seq) - 1)]
            near = near[~last[near]]
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        lefts.append(left), rights.append(right), sizes.append(len(used))
    pairs = np.stack([np.concatenate(lefts), np.concatenate(rights)]).astype("<u4") if sizes else np.zeros((2, 0), "<u4")
    return {"n_terminals": n_terminals, "rules": pairs, "round_sizes": sizes, "expansions": lengths[n_terminals:].astype("<u4"), "symbols": seq.astype("<u4")}


def expand(symbols: np.ndarray, n_terminals: int, rules: np.ndarray, round_sizes: list[int]) -> np.ndarray:
    """The ids that symbols stand for; undoes the rounds, the last one first."""
    seq = symbols.astype(np.int64)
    top = n_terminals + sum(round_sizes)
    for size in reversed(round_sizes):
        low = top - size
        at = np.flatnonzero(seq >= low)
        if len(at):
            rule = seq[at] - n_terminals
            seq = np.repeat(seq, 1 + (seq >= low))
            at = at + np.arange(len(at))
            seq[at], seq[at + 1] = rules[0][rule], rules[1][rule]
        top = low
    return seq.astype("<u4")


def _planes(symbols: np.ndarray) -> bytes:
    return symbols.astype("<u2").tobytes() + (symbols >> np.uint32(16)).astype("<u2").tobytes()


def _joined(planes: bytes) -> np.ndarray:
    low, high = np.frombuffer(planes, "<u2").reshape(2, -1)
    return low.astype("<u4") | (high.astype("<u4") << np.uint32(16))


def _loaded(row: dict) -> tuple:
    return _joined(row["symbols"]), row["n_terminals"], np.frombuffer(row["rules"], "<u4").reshape(2, -1), row["round_sizes"]


def decode_block(row: dict) -> np.ndarray:
    """All ids of a block's row."""
    return expand(*_loaded(row))


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop-1 of a block; expands only the symbols that cover them."""
    symbols, n_terminals, rules, sizes = _loaded(row)
    lengths = np.concatenate([np.ones(n_terminals, np.int64), np.frombuffer(row["expansions"], "<u4")])
    ends = np.cumsum(lengths[symbols])
    i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[i - 1]) if i else 0
    return expand(symbols[i:j], n_terminals, rules, sizes)[start - skipped : stop - skipped]


def _block_row(shard, block, doc_ids, ids, counts):
    g = build_grammar(ids, counts)
    values = [shard, block, len(ids), g["n_terminals"], doc_ids, counts.astype("<u4").tobytes(), g["rules"].tobytes(), g["round_sizes"], g["expansions"].tobytes(), _planes(g["symbols"])]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["shard", "block", "n_ids", "n_terminals", "doc_ids", "doc_tokens", "rules", "round_sizes", "expansions", "symbols"]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Tokenizes every text and writes the grammar files below path, in ascending doc_id order."""
    spark = docs.sparkSession
    texts = clean_docs(docs)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def pack(batches):
        shard, block = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, words=False)
        doc_ids, ids, counts, n = [], [], [], 0
        for (doc,), data, offsets in blocks(batches):
            got, lens = encode(data, offsets, end_id)
            doc_ids += doc.to_pylist()
            ids.append(got), counts.append(lens)
            n += len(got)
            if n >= BLOCK_TOKENS:
                yield _block_row(shard, block, doc_ids, np.concatenate(ids), np.concatenate(counts))
                block, doc_ids, ids, counts, n = block + 1, [], [], [], 0
        if n:
            yield _block_row(shard, block, doc_ids, np.concatenate(ids), np.concatenate(counts))

    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """(shard, block, base): how many ids stand before each block, those of earlier shards (a row for each) and of earlier blocks of its own."""
    sizes = files.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    within = Window.partitionBy("shard").orderBy("block")
    return sizes.withColumn("own", F.sum("n_ids").over(within) - F.col("n_ids")).join(shards, "shard").select("shard", "block", (F.col("own") + F.col("before")).alias("base"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(at, ids): the ids start .. stop-1 of the whole table, a row for each block that holds some; only these blocks are read and
    only the symbols that cover the range are expanded."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    wanted = _starts(files).join(files.select("shard", "block", "n_ids"), ["shard", "block"]).where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["base"]), min(row["n_ids"], stop - row["base"])
                yield pa.record_batch([pa.array([row["base"] + a]), pa.array([decode_range(row, a, b).tolist()], pa.list_(pa.int64()))], ["at", "ids"])

    return files.join(wanted.select("shard", "block", "base"), ["shard", "block"]).mapInArrow(cut, "at long, ids array<long>")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below path."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = decode_block(row), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                n = len(counts)
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(digest, "doc_id long, shard int, block int, at long, n_tokens long, ids_crc32 long")
    return docs.join(_starts(files), ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
