"""The corpus pipeline: five stages over the documents table, each one operator.

Every stage gets what the one before kept. All but the last return the columns of
documents; extra columns pass through the first four. An empty table gives an empty
result at every stage, and nulls, ties and repeated rows are treated as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlight.llm import bpe, mixing, ngram_join, pii, quality
from pathlight.llm.common import documents, materialize


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal datum in a text replaced by its kind."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token counts and digests for each document of the mix."""
    return bpe.encode_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality_rules", good_texts),
    ("ngram_jaccard_join", one_of_each),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed_sources),
    ("bpe", encoded),
]

#: SQL can't express the merges of the last stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
