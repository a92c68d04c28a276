"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import read_table, shared_path
from .tokens import tokenizer_path


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op01_repair as op

    path = shared_path(spark, "token-ids")
    op.write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return op.read_ids(spark, path)


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op08_sumsquares as op

    return op.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op10_twotier as op

    return op.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op3_winnowing_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op03_winnow as op

    return op.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op04_crf as op

    docs = read_table(spark, sf_dir, "documents")
    return op.quality(docs, op.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op06_chains as op

    docs = read_table(spark, sf_dir, "documents")
    return op.toxicity(docs, op.fit(docs, read_table(spark, sf_dir, "labels")), threshold=0.5)


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op07_telephony as op

    return op.telephony(read_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op02_suffix as op

    return op.removal(read_table(spark, sf_dir, "documents"))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op09_recompress as op

    return op.removal(read_table(spark, sf_dir, "documents"))


def op5_divideskip_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op05_divideskip as op

    return op.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op11_audit as op

    return op.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op12_simhash as op

    return op.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op13_resample as op

    return op.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024, least_words=20, per_cent=10)


def queries() -> dict:
    return {f.__name__: f for f in (op1_repair_token_ids, op2_suffix_array_dedup, op3_winnowing_contamination, op4_crf_quality, op5_divideskip_near_duplicates, op6_toxicity_chain, op7_telephony_audio, op8_sum_of_squares_packing, op9_recompression_dedup, op10_two_tier_token_counts, op11_filter_audit, op12_deletion_variant_simhash, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a model or a codec."""
    return {
        "op2_suffix_array_dedup": oracles.SUFFIX,
        "op3_winnowing_contamination": oracles.CONTAMINATION,
        "op5_divideskip_near_duplicates": oracles.NEAR_DUPLICATES,
        "op9_recompression_dedup": oracles.REPEATED_WINDOWS,
        "op11_filter_audit": oracles.FILTER_AUDIT,
        "op13_importance_resampling": oracles.RESAMPLING,
    }
