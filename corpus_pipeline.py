"""From the table documents to packed training sequences, in five stages.

1. language_id: documents without a language that the evidence supports go; lang becomes the identified language.
2. exact_dedup: of equal texts (but for A-Z) the largest doc_id stays.
3. ngram_join: of each class of near copies (five words, Jaccard similarity 0.8) the least doc_id stays.
4. pii: personal data is replaced by its kind.
5. packing: the texts' tokens are dealt into sequences of 2048.

Each stage works on all that the one before kept, and returns the columns of documents, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, ngram_join, packing, pii
from tessera.llm.common import documents, scratch
from tessera.llm.queries import tokenizer


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_a_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
