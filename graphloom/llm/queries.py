"""Queries of the training-data operators over the driver's tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, embed_dedup, langid, mixing, omh, quality, sentencepieces, simhash_dedup, tokenfile, urlfilter
from .shared import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.duplicates(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy="copy")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_shards(table(spark, sf_dir, "documents"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.made_pairs(table(spark, sf_dir, "conversations")))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.unlisted(pages, urlfilter.listed_urls(pages))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_sentencepiece, op3_mix_sources, op4_simhash_dedup, op5_quality,
        op6_language_id, op7_token_shards, op8_preference_pairs, op9_order_minhash, op10_url_filter,
    )
}

ORACLE_SQL = {"op3_mix_sources": mixing.sql(), "op8_preference_pairs": chat.sql(), "op10_url_filter": urlfilter.sql()}
