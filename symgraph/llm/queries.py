"""The queries of this subpackage and their SQL, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, line_dedup, mixing, quality_classifier, quality_rules, simhash, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_simhash_dedup": simhash.query,
        "op3_quality_rules": quality_rules.query,
        "op4_token_counts": token_counts.query,
        "op5_embedding_dedup": embedding_dedup.query,
        "op6_byte_bpe": bpe.query,
        "op7_line_dedup": line_dedup.query,
        "op8_source_mixing": mixing.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.SQL,
        "op7_line_dedup": line_dedup.SQL,
    }
