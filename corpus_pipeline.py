"""A corpus from raw documents to packed training sequences, in five stages.

Each stage reads all that the one before it kept. All but the last return the columns of ``documents``, whatever other columns these
have. A null text counts as an empty one; rows without doc_id go in the first stage that meets them; very long texts are whole.
An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import op02_suffix, op03_winnow, op04_crf, op05_divideskip, op08_sumsquares
from tremorlake.llm.common import discard, read_table, written
from tremorlake.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject. Null and empty texts are scored like others. Rows that share a doc_id stay or go
    together: they stay if the model accepts any of them. Without usable labels all stay."""
    model = op04_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    good = op04_crf.quality(docs, model).where("predicted = 1").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of its smallest doc_id; of repeated rows one. Documents without words (null texts,
    too) are no duplicates of others. No documents give none."""
    return op05_divideskip.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings; a document stays even if little or nothing of it is left. Repeated rows
    are one occurrence and keep the same text; null texts become empty ones."""
    out = op02_suffix.rewritten(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark in any row of their doc_id. Null and empty texts are clean; so is all without a
    benchmark."""
    clean = op03_winnow.contamination(docs, read_table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.bool_or("contaminated").alias("hit")).where("NOT hit")
    return docs.join(clean, "doc_id", "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence of at most 4096 tokens that each is placed in. Null and empty texts are one end id; repeated
    rows are packed each."""
    return op08_sumsquares.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", substrings), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: SQL can express neither the line model nor tokenizing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
            discard(before)
    return docs
