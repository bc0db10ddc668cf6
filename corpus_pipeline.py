"""From raw documents to a training mix, stage by stage.

Each stage takes all that its predecessor kept, written as Parquet and read again, and its decisions take effect. All but the last return the
columns of documents; the last returns the encoded mix, with each row's position in it.

Defined results for odd input, stage by stage (each is its operator's, whose module says more):
* quality_rules: a null or empty text, or one without a word, goes; null lang or source is a group of its own; a tie on a fence stays; rows that repeat are judged alike;
* line_dedup: a null or empty text stays as it is; a document of which nothing is left goes; rows that repeat a document stay or go alike; long lines are compared whole;
* near_dedup: a text without a word, or without an id, stays; of a group of near copies, and of rows that repeat a doc_id, one stays (least doc_id, then least text);
* source_mixing: no row goes, whatever is null; ties by source name, then doc_id, then text;
* byte_bpe: a null text has null ids, an empty one none; every row has its position;
* an empty table gives an empty one at every stage; extra columns pass through all but the last, whatever they are called; texts are never cut.

Near copies are looked for after line dedup, as the stages are ordered: what line dedup has left of a later copy are the lines that differ from the
earlier one's, so few near copies are left to find there (README has the figures).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import bpe, common, line_dedup, mixing, quality_rules, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of their language and source go."""
    return quality_rules.filter_documents(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; so does a document of which nothing is left."""
    return line_dedup.clean_documents(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of least id stays."""
    return simhash.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are interleaved at their target weights; when one runs out, the others go on."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's position in the mix, token ids, the characters that each token spans, and the text decoded from the ids again."""
    return bpe.round_trip_in_order(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has neither SimHash nor the tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
