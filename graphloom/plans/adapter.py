"""The driver's tables as a layered graph, once for Spark and once as SQL.

Parts are memes, customers persons, orders events, suppliers sites, nations series and regions subcultures;
documents and embeddings are text and image instances of parts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import slug
from ..operators.corpus import instance_triples, unified_instances
from ..schema import iri, literal, melt
from ..session import importable, shared_folder, spread
from ..sources.triples import read_store, write_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def build_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of entries, their metadata and their relations; each triple once."""
    t = lambda name: table(spark, sf_dir, name)
    part, customer, supplier, orders, lineitem = t("part"), t("customer"), t("supplier"), t("orders"), t("lineitem")
    nation, region = t("nation"), t("region")
    # one exchange of the items, by part, has both their distinct pairs and the counts
    pairs = spread(lineitem.filter("l_partkey is not null").select("l_partkey", "l_orderkey"), "l_partkey", rows=lineitem.count()).groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("l_partkey").agg(F.sum("n").alias("views"), F.count("l_orderkey").alias("comments"))
    brand, ptype = part.select("p_brand").distinct(), part.select("p_type").distinct()
    first = lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    n = max(first.count(), orders.count())
    sold = spread(first, "l_orderkey", rows=n).join(spread(orders.select("o_orderkey", "o_custkey"), "o_orderkey", rows=n).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    party = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")) for kind, key in (("supplier/", "l_suppkey"), ("customer/", "o_custkey")))))
    sold = spread(sold.select("l_partkey", party.alias("x")).select("l_partkey", "x.*"), "l_partkey", "kind", "key", rows=2 * n).distinct()
    s = node("part", "p_partkey")
    frames = [
        melt(part, s, iri(V.TYPE, V.MEME), literal(V.LABEL, F.col("p_name")), literal(V.ID, F.col("p_partkey"), V.INTEGER)),
        melt(part, s, iri(V.HAS_TAG, F.concat(F.lit("brand/"), slug(F.col("p_brand")))), iri(V.HAS_MEME_TYPE, F.concat(F.lit("ptype/"), slug(F.col("p_type")))), iri(V.PART_OF_SERIES, node("nation", F.col("p_partkey") % 25))),
        melt(counts, node("part", "l_partkey"), literal(V.VIEWS, F.col("views"), V.INTEGER), literal(V.COMMENTS, F.col("comments"), V.INTEGER)),
        melt(brand, F.concat(F.lit("brand/"), slug(F.col("p_brand"))), iri(V.TYPE, V.TAG), literal(V.LABEL, F.col("p_brand"))),
        melt(ptype, F.concat(F.lit("ptype/"), slug(F.col("p_type"))), iri(V.TYPE, V.MEME_TYPE), literal(V.LABEL, F.col("p_type"))),
        melt(orders, node("order", "o_orderkey"), iri(V.TYPE, V.EVENT), literal(V.YEAR, F.year("o_orderdate"), V.GYEAR), iri(V.HAS_STATUS, F.concat(F.lit("status/"), slug(F.col("o_orderstatus")))), iri(V.BELONGS_TO, node("customer", "o_custkey"))),
        # keys are made distinct before they become names, which are some times as wide
        melt(pairs, node("order", "l_orderkey"), iri(V.MENTIONS, node("part", "l_partkey"))),
        melt(sold, node("part", "l_partkey"), iri(V.MENTIONS, F.concat("kind", F.col("key").cast("string")))),
        melt(customer, node("customer", "c_custkey"), iri(V.TYPE, V.PERSON), literal(V.LABEL, F.col("c_name")), iri(V.PART_OF_SERIES, node("nation", "c_nationkey")), iri(V.HAS_BADGE, F.concat(F.lit("segment/"), slug(F.col("c_mktsegment"))))),
        melt(customer.filter("c_acctbal > 9000"), node("customer", "c_custkey"), iri(V.SAME_AS, F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("c_custkey").cast("string")))),
        melt(supplier, node("supplier", "s_suppkey"), iri(V.TYPE, V.SITE), literal(V.LABEL, F.col("s_name")), iri(V.PART_OF_SERIES, node("nation", "s_nationkey"))),
        melt(nation, node("nation", "n_nationkey"), iri(V.TYPE, V.SERIES), literal(V.LABEL, F.col("n_name")), iri(V.PART_OF_SERIES, node("region", "n_regionkey"))),
        melt(region, node("region", "r_regionkey"), iri(V.TYPE, V.SUBCULTURE), literal(V.LABEL, F.col("r_name"))),
    ]
    return reduce(DataFrame.unionByName, frames)


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text instances: documents whose number isn't a multiple of 5."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0").join(labels, "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "confirmed").otherwise("unconfirmed")
    return docs.select(F.col("doc_id").cast("string").alias("filename"), F.col("doc_id").alias("idx"), F.col("source").alias("class_id"), kind.alias("dataset_type"), F.col("doc_id").alias("entry_id"), "text")


def vision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image instances: embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("filename"), F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("class_id"), F.lit("confirmed").alias("dataset_type"), F.col("vec_id").alias("entry_id"), "embedding")


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_instances(vision_rows(spark, sf_dir).drop("embedding"), text_rows(spark, sf_dir))


def build_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the instances that have an entry."""
    parents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), node("part", "p_partkey").alias("entry"))
    return instance_triples(unified(spark, sf_dir).join(parents, "entry_id"), F.concat(F.lit("instance/"), F.col("filename")))


_stores: dict[tuple[str, str, str], tuple[tuple, str]] = {}
_SOURCES = ("part", "customer", "supplier", "orders", "lineitem", "nation", "region", "labels", "documents", "embeddings")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the tables' files."""
    out = []
    for name in _SOURCES:
        fs, at = _hadoop(spark, f"{sf_dir}/{name}.parquet")
        out += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return tuple(out)


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The triples as a table by predicate, so that queries read only theirs; written anew when the tables' files change."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key in _stores and _stores[key][0] != state:
        fs, at = _hadoop(spark, _stores.pop(key)[1])
        fs.delete(at, True)
    if key not in _stores:
        path = f"{shared_folder(spark)}/triples-{uuid.uuid4().hex}"
        write_store(build(spark, sf_dir), path)
        _stores[key] = state, path
    return read_store(spark, _stores[key][1])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "entries", build_entries)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "instances", build_instances)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).unionByName(instances(spark, sf_dir))


# -- the same as SQL ----------------------------------------------------------------------------------------


def slug_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' WHEN trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') = '' THEN 'item' ELSE trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') END"


def _rows(source: str, s: str, *terms: tuple[str, str, str], distinct: bool = False) -> str:
    d = "DISTINCT " if distinct else ""
    return "\nUNION ALL ".join(f"SELECT {d}{s} AS s, '{p}' AS p, ({o})::VARCHAR AS o, '{kind}' AS o_kind FROM {source} WHERE ({o}) IS NOT NULL" for p, o, kind in terms)


_SOLD = "(SELECT l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)"
ENTRIES_SQL = "\nUNION ALL ".join(
    [
        _rows("part", "'part/' || p_partkey", (V.TYPE, f"'{V.MEME}'", "iri"), (V.LABEL, "p_name", "literal"), (V.ID, "p_partkey", "literal"), (V.HAS_TAG, f"'brand/' || {slug_sql('p_brand')}", "iri"), (V.HAS_MEME_TYPE, f"'ptype/' || {slug_sql('p_type')}", "iri"), (V.PART_OF_SERIES, "'nation/' || (p_partkey % 25)", "iri")),
        _rows("(SELECT l_partkey, count(*) AS views, count(DISTINCT l_orderkey) AS comments FROM lineitem GROUP BY l_partkey)", "'part/' || l_partkey", (V.VIEWS, "views", "literal"), (V.COMMENTS, "comments", "literal")),
        _rows("(SELECT DISTINCT p_brand FROM part)", f"'brand/' || {slug_sql('p_brand')}", (V.TYPE, f"'{V.TAG}'", "iri"), (V.LABEL, "p_brand", "literal")),
        _rows("(SELECT DISTINCT p_type FROM part)", f"'ptype/' || {slug_sql('p_type')}", (V.TYPE, f"'{V.MEME_TYPE}'", "iri"), (V.LABEL, "p_type", "literal")),
        _rows("orders", "'order/' || o_orderkey", (V.TYPE, f"'{V.EVENT}'", "iri"), (V.YEAR, "year(o_orderdate)", "literal"), (V.HAS_STATUS, f"'status/' || {slug_sql('o_orderstatus')}", "iri"), (V.BELONGS_TO, "'customer/' || o_custkey", "iri")),
        _rows("lineitem", "'order/' || l_orderkey", (V.MENTIONS, "'part/' || l_partkey", "iri"), distinct=True),
        _rows(_SOLD, "'part/' || l_partkey", (V.MENTIONS, "'supplier/' || l_suppkey", "iri"), (V.MENTIONS, "'customer/' || o_custkey", "iri"), distinct=True),
        _rows("customer", "'customer/' || c_custkey", (V.TYPE, f"'{V.PERSON}'", "iri"), (V.LABEL, "c_name", "literal"), (V.PART_OF_SERIES, "'nation/' || c_nationkey", "iri"), (V.HAS_BADGE, f"'segment/' || {slug_sql('c_mktsegment')}", "iri")),
        _rows("(SELECT * FROM customer WHERE c_acctbal > 9000)", "'customer/' || c_custkey", (V.SAME_AS, "'http://www.wikidata.org/entity/Q' || c_custkey", "iri")),
        _rows("supplier", "'supplier/' || s_suppkey", (V.TYPE, f"'{V.SITE}'", "iri"), (V.LABEL, "s_name", "literal"), (V.PART_OF_SERIES, "'nation/' || s_nationkey", "iri")),
        _rows("nation", "'nation/' || n_nationkey", (V.TYPE, f"'{V.SERIES}'", "iri"), (V.LABEL, "n_name", "literal"), (V.PART_OF_SERIES, "'region/' || n_regionkey", "iri")),
        _rows("region", "'region/' || r_regionkey", (V.TYPE, f"'{V.SUBCULTURE}'", "iri"), (V.LABEL, "r_name", "literal")),
    ]
)

TEXT_SQL = "SELECT doc_id AS idx, source AS class_id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'unconfirmed' END AS dataset_type, text FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE doc_id % 5 <> 0"
VISION_SQL = "SELECT vec_id AS idx, label::VARCHAR AS class_id, 'confirmed' AS dataset_type FROM embeddings"
UNIFIED_SQL = f"""SELECT coalesce(v.idx, t.idx)::VARCHAR AS filename, coalesce(v.idx, t.idx) AS entry_id, coalesce(v.class_id, t.class_id) AS class_id,
  coalesce(v.dataset_type, t.dataset_type) AS dataset_type, v.idx AS vision_idx, t.idx AS text_idx, t.text,
  CASE WHEN t.idx IS NULL THEN 'vision' WHEN v.idx IS NULL THEN 'text' ELSE 'both' END AS modality
FROM ({VISION_SQL}) v FULL OUTER JOIN ({TEXT_SQL}) t ON v.idx = t.idx"""
INSTANCES_SQL = _rows(
    "(SELECT u.* FROM unified u JOIN part ON p_partkey = entry_id)", "'instance/' || filename", (V.TYPE, f"'{V.INSTANCE}'", "iri"), (V.BELONGS_TO, "'part/' || entry_id", "iri"),
    (V.LABEL, "filename", "literal"), (V.MODALITY, "modality", "literal"), (V.DATASET_TYPE, "dataset_type", "literal"), (V.VISION_INDEX, "vision_idx", "literal"), (V.TEXT_INDEX, "text_idx", "literal"), (V.OCR_TEXT, "text", "literal"),
)


def with_graph(query: str, instances: bool = False, extra: str = "") -> str:
    """``query`` over ``g(s, p, o, o_kind)`` and ``types(s, t)``, and other CTEs if named."""
    more = f", unified AS ({UNIFIED_SQL})" if instances else ""
    body = ENTRIES_SQL + ("\nUNION ALL " + INSTANCES_SQL if instances else "")
    head = f"WITH {more[2:] + ', ' if more else ''}g AS MATERIALIZED ({body}), types AS (SELECT s, o AS t FROM g WHERE p = '{V.TYPE}')"
    return f"{head}{', ' + extra if extra else ''}\n{query}"
