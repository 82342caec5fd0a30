"""A training-data pipeline over ``documents``: each stage is one operator, written as Parquet and read again by the next.

Nulls in any column, empty texts and repeated rows pass through each stage as
its operator defines: rows without letters leave with the language stage, of
equal rows one stays, rows without doc_id are judged by their texts like
others, an empty table gives an empty result.  Columns of any name are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from tessera.llm.common import table, written


#: Words of the shortest repeated passage that is cut: every one of more than 50, whatever its bytes.
PASSAGE = 51


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a clear language."""
    return language_id.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return simhash.keep_one(docs, simhash.WIDTH, simhash.SIMILARITY)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats verbatim across the documents that are left."""
    return suffix_dedup.cut_repeats(docs, PASSAGE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The fitted classifier, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
