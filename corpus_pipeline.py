"""The corpus pipeline: each stage keeps, repeats or encodes what the one before it kept.

All stages take tables without rows, rows with nulls in any column, empty and very long texts, repeated rows,
and extra columns of any name, which all but the last give back as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, mixing, quality, sentencepieces, simhash_dedup
from graphloom.llm.shared import cut, join_checked, own, prepared, remove, rewritten, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling toward the good labels keeps.

    Null and blank texts go. Rows tied with the last that is kept stay, and so do repeated rows of it. A null
    ``doc_id`` has no label and is kept or not by its text. Without labels of both kinds all other rows stay.
    """
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by models of the languages of ``docs``; ``lang`` becomes that language.

    Null, blank and undecided texts go; in a tie of two languages a text is undecided. Repeated rows stay or
    go together. A null ``lang`` fits no model but gets the language that is told.
    """
    prepared(spark)
    return langid.accepted(docs, lang="lang")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least ``doc_id``.

    Rows without a ``doc_id``, and null and blank texts, stay. Rows that share a ``doc_id`` stay or go together.
    """
    prepared(spark)
    gone = cut(simhash_dedup.duplicates(docs).select("doc_id"))
    return join_checked(docs, gone, "doc_id", "left_anti").select(*own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same tokens.

    Rows of a null source, or of one without tokens, go. Null and empty texts are repeated like their source.
    Repeated rows, and those of a source without a ``doc_id``, are drawn together.
    """
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, as (doc_id, ids, n_tokens, round_trip); null and empty texts have none, repeated rows the same."""
    prepared(spark)
    return sentencepieces.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", sentencepiece),
]

#: Importance resampling, context trees, SimHash and SentencePiece can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage reads the Parquet that the one before it wrote, which is then removed."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = rewritten(stage(spark, docs, sf_dir))
        if i:
            remove(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
