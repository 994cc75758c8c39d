"""Mixing sources to target weights by fractional repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name, own

SEED = 41
#: Rates of at most so many sources are broadcast; more are joined by a shuffle with the documents.
BROADCAST_SOURCES = 100_000
#: White space that ends a token.
TOKEN = "[^ \\t\\n\\r]+"


def n_tokens(text) -> F.Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, tokens, rate): how often each source's documents are to be emitted.

    A source's rate is its share of the weights times ``total`` over its tokens. Without ``weights`` all
    sources with tokens weigh the same; a source that isn't named in them weighs 0. ``total`` is that of the
    tokens of ``docs`` unless given. A source without tokens has rate 0.
    """
    per = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(n_tokens(F.col("text").cast("string")), F.lit(0))).alias("tokens")).filter(F.col("source").isNotNull())
    per = cut(per)
    if weights is None:
        weighed = per.withColumn("weight", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()] or [("", 0.0)], "source string, weight double")
        weighed = per.join(given, "source", "left").fillna(0.0, ["weight"]).withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0))
    all_ = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))
    goal = F.col("all_tokens").cast("double") if total is None else F.lit(float(total))
    rate = F.when((F.col("tokens") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * goal / F.col("tokens")).otherwise(F.lit(0.0))
    return weighed.crossJoin(all_).select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its source's rate says, with its own columns.

    A row comes floor(rate) times, and once more if a hash of seed and ``doc_id`` is under the fraction; so
    the choice is the same on every run, and tokens meet the targets in expectation. ``copy`` names a column
    for the number of the copy, from 0. Rows of a null source, or of one of rate 0, go. Rows of a null or
    repeated ``doc_id`` are drawn together. Null and empty texts count no tokens and are repeated like their
    source. No rows give no rows.
    """
    per = cut(rates(docs, weights, total))
    s, r, n = (free_name(docs, x) for x in ("mix_source", "mix_rate", "mix_copy"))
    per = per.select(F.col("source").alias(s), F.col("rate").alias(r))
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(per) if few else per, docs["source"].cast("string") == per[s])
    # 52 bits of the hash are exact in a double, here and in SQL
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    times = F.floor(F.col(r)) + F.when(head / F.lit(float(1 << 52)) < F.col(r) - F.floor(F.col(r)), 1).otherwise(0)
    out = joined.withColumn(n, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))))
    return out.select(*own(docs), *([F.col(n).alias(copy)] if copy else []))


def sql(seed: int = SEED) -> str:
    """``mix`` with equal weights, over ``documents``, as SQL."""
    return rf"""
WITH per AS (
  SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)) AS tokens
  FROM documents WHERE source IS NOT NULL GROUP BY source
), goal AS (
  SELECT sum(CASE WHEN tokens > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS all_weight, sum(tokens)::DOUBLE AS all_tokens FROM per
), rates AS (
  SELECT source, CASE WHEN tokens > 0 THEN 1.0::DOUBLE / all_weight * all_tokens / tokens::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM per, goal
), drawn AS (
  SELECT d.*, r.rate,
    floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS times
  FROM documents d JOIN rates r ON d.source = r.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(times)) AS copy FROM drawn
"""
