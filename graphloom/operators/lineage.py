"""From similar items to the entries that they belong to, and on to what those mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import local_name, valid_tag
from .patterns import labels, match, types

#: Categories by the order in which they claim a name.
CATEGORIES = ["people", "events", "sites", "subcultures", "series", "memes", "tags"]
_BY_TYPE = {V.PERSON: "people", V.EVENT: "events", V.SITE: "sites", V.SUBCULTURE: "subcultures", V.MEME: "memes"}


def bridge(triples: DataFrame, hits: DataFrame) -> DataFrame:
    """(entry, label, hits, best_rank): the entries of the hits' instances, from rows of instance and rank."""
    parent = match(triples, p=V.BELONGS_TO).select(F.col("s").alias("instance"), F.col("o").alias("entry"))
    known = labels(triples).withColumnRenamed("s", "entry")
    # an instance with several parents counts for the first that has a label
    one = hits.select("instance", "rank").join(parent, "instance").join(known, "entry").groupBy("instance", "rank").agg(F.min(F.struct("entry", "label")).alias("e"))
    return one.groupBy("e.entry", "e.label").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))


def semantics(triples: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, category, name): what each entry relates to, by the predicate or the first class that applies.

    Of names that are equal but for case, one category of an entry keeps one, and those after it lose it.
    """
    rows = match(triples, p=[V.HAS_TAG, V.PART_OF_SERIES, V.MENTIONS]).select(F.col("s").alias("entry"), "p", F.col("o").alias("e")).join(entries.select("entry").distinct(), "entry", "left_semi")
    kinds = types(triples).withColumnRenamed("s", "e").groupBy("e").agg(F.collect_set("t").alias("ts"))
    named = rows.join(kinds, "e", "left").join(labels(triples).withColumnRenamed("s", "e"), "e", "left")
    category = F.when(F.col("p") == V.HAS_TAG, "tags").when(F.col("p") == V.PART_OF_SERIES, "series")
    for t, c in _BY_TYPE.items():
        category = category.when(F.array_contains("ts", t), c)
    name = F.coalesce("label", local_name(F.col("e")))
    named = named.withColumn("category", category).filter("category is not null").select("entry", "category", F.when(F.col("category") == "tags", F.lower(name)).otherwise(name).alias("name"))
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    w = Window.partitionBy("entry", F.lower(F.trim("name"))).orderBy(rank, "name")
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def flow(bridged: DataFrame, meanings: DataFrame, query: str = "query", per_category: int = 8) -> DataFrame:
    """(source, target, weight): links from the query to entries, by hits, and from these to the names of each category
    that most entries have, tags that are stop words left out and subcultures not drawn."""
    first = bridged.select(F.lit(query).alias("source"), F.col("entry").alias("target"), F.col("hits").cast("long").alias("weight"))
    drawn = meanings.filter((F.col("category") != "subcultures") & ((F.col("category") != "tags") | valid_tag(F.col("name")))).select("entry", "category", "name").distinct()
    per = drawn.groupBy("category", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "name")
    top = per.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_category).select("category", "name")
    second = drawn.join(F.broadcast(top), ["category", "name"])  # at most per_category names of each of six categories
    return first.unionByName(second.select(F.col("entry").alias("source"), F.concat("category", F.lit(":"), "name").alias("target"), F.lit(1).cast("long").alias("weight")))


def representative(hits: DataFrame, paths: DataFrame) -> DataFrame:
    """(entry, path): the path of each entry's best hit that has one."""
    return hits.join(paths.filter("path is not null"), "instance").groupBy("entry").agg(F.min_by("path", "rank").alias("path"))


def network(memes: DataFrame, others: DataFrame, target: str, n_memes: int = 20, n_others: int = 12) -> DataFrame:
    """(source, target, weight): the target's strongest memes, and the entities that most of them share."""
    top = memes.orderBy(F.desc("engagement"), "meme").limit(n_memes)
    kept = others.join(top.select("meme"), "meme", "left_semi")
    best = kept.groupBy("e").agg(F.count_distinct("meme").alias("n")).orderBy(F.desc("n"), "e").limit(n_others).select("e")
    a = top.select(F.lit(target).alias("source"), F.col("meme").alias("target"), F.round(F.greatest(F.col("engagement") / 1e6, F.lit(0.3)), 6).alias("weight"))
    return a.unionByName(kept.join(best, "e", "left_semi").select(F.col("meme").alias("source"), F.col("e").alias("target"), F.lit(0.3).alias("weight")).distinct())
