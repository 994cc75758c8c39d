"""Pattern, statistics, inference, connection and traversal queries over the graph of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import lineage, patterns, stats, traversal
from ..ontology import TERMS, vocabulary as vocabulary_triples
from ..schema import iri, literal, melt
from .adapter import entries, graph, with_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TYPED = f"SELECT s, o AS t FROM g WHERE p = '{V.TYPE}'"
_LABELS = f"SELECT s, min(o) AS label FROM g WHERE p = '{V.LABEL}' GROUP BY s"
_TAIL = "regexp_extract({}, '[^/#:]*$')"
_EDGES = f"SELECT s, p, o FROM g WHERE o_kind = 'iri' AND p <> '{V.TYPE}'"
_DEGREES = f"SELECT e, sum(x)::BIGINT AS out_degree, sum(y)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT s AS e, 1 AS x, 0 AS y FROM ({_EDGES}) UNION ALL SELECT o, 0, 1 FROM ({_EDGES})) GROUP BY e"
_CONNECTIONS = ", ".join(f"'{p}'" for p in V.CONNECTIONS)
_MEME_EDGES = f"SELECT g.s AS meme, p, regexp_extract(p, '[^/#:]*$') AS kind, o AS e FROM g WHERE p IN ({_CONNECTIONS}) AND s IN (SELECT s FROM types WHERE t = '{V.MEME}')"
_WEIGHT = "CASE p " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in V.CONNECTIONS.items()) + " END"


@query(with_graph("SELECT t AS class, count(*) AS n FROM types GROUP BY t", instances=True))
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_counts(graph(spark, sf_dir))


@query(with_graph(f"SELECT p, count(*) AS n, p LIKE 'kg:%' AS own FROM g WHERE p NOT IN ({', '.join(repr(p) for p in V.STRUCTURAL)}) GROUP BY p", instances=True))
def property_usage(spark, sf_dir):
    return stats.property_usage(graph(spark, sf_dir))


@query(with_graph("""
SELECT count(*) AS triples, count(*) FILTER (WHERE o_kind = 'iri') AS edges, count(*) FILTER (WHERE o_kind <> 'iri') AS literal_triples,
  count(DISTINCT s) AS subjects, count(DISTINCT CASE WHEN o_kind = 'iri' THEN o END) AS iri_objects, count(DISTINCT CASE WHEN o_kind <> 'iri' THEN o END) AS literal_objects,
  (SELECT count(*) FROM (SELECT s FROM g UNION SELECT o FROM g WHERE o_kind = 'iri')) AS nodes,
  round(count(*) FILTER (WHERE o_kind = 'iri') * 100.0::DOUBLE / count(*), 6) AS iri_percent
FROM g""", instances=True))
def graph_structure(spark, sf_dir):
    return stats.graph_structure(graph(spark, sf_dir))


@query(with_graph("SELECT CASE WHEN p LIKE 'rdf:%' THEN 'rdf' WHEN p LIKE 'rdfs:%' THEN 'rdfs' WHEN p LIKE 'owl:%' THEN 'owl' WHEN p LIKE 'kg:%' THEN 'kg' ELSE 'other' END AS family, count(*) AS n, count(DISTINCT p) AS predicates, count(*) FILTER (WHERE o_kind = 'iri') AS edges FROM g GROUP BY 1", instances=True))
def relation_families(spark, sf_dir):
    return stats.relation_families(graph(spark, sf_dir))


@query(with_graph(f"""
SELECT count(*) AS entities, round(avg(degree), 6) AS avg_degree, round(avg(out_degree), 6) AS avg_out, round(avg(in_degree), 6) AS avg_in, max(degree) AS max_degree, min(degree) AS min_degree, count(*) FILTER (WHERE degree = 0) AS isolated
FROM (SELECT t.e, coalesce(degree, 0) AS degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM (SELECT DISTINCT s AS e FROM types) t LEFT JOIN ({_DEGREES}) d ON t.e = d.e)"""))
def degree_stats(spark, sf_dir):
    return stats.degree_stats(entries(spark, sf_dir))


@query(with_graph("""
SELECT nodes, edges, round(edges * 100.0::DOUBLE / (nodes::DOUBLE * (nodes - 1)), 9) AS density_percent, round(100 - edges * 100.0::DOUBLE / (nodes::DOUBLE * (nodes - 1)), 9) AS sparsity_percent,
  round(edges / nodes::DOUBLE, 6) AS edges_per_node, round(triples / nodes::DOUBLE, 6) AS triples_per_node
FROM (SELECT count(*) AS triples, count(*) FILTER (WHERE o_kind = 'iri') AS edges, (SELECT count(*) FROM (SELECT s FROM g UNION SELECT o FROM g WHERE o_kind = 'iri')) AS nodes FROM g)"""))
def density(spark, sf_dir):
    return stats.density(entries(spark, sf_dir))


@query(with_graph(f"SELECT e, degree FROM ({_DEGREES}) ORDER BY degree DESC, e LIMIT 20"))
def most_connected(spark, sf_dir):
    return stats.most_connected(entries(spark, sf_dir))


@query(with_graph(f"SELECT p, count(*) AS n, count(DISTINCT s) AS entities FROM g WHERE p IN ('{V.YEAR}', '{V.DATE_CREATED}', '{V.TEMPORAL}') GROUP BY p"))
def temporal_coverage(spark, sf_dir):
    return stats.temporal_coverage(entries(spark, sf_dir))


@query(with_graph(f"""
SELECT *, round(linked * 100.0::DOUBLE / entities, 6) AS link_rate, round(multi_typed * 100.0::DOUBLE / entities, 6) AS multi_typed_rate FROM (
  SELECT count(*) AS entities, count(*) FILTER (WHERE n > 1) AS multi_typed,
    (SELECT count(*) FROM g WHERE p = '{V.SAME_AS}' AND o LIKE '%wikidata.org%') AS wikidata_links, (SELECT count(*) FROM g WHERE p = '{V.SAME_AS}' AND o NOT LIKE '%wikidata.org%') AS other_links,
    (SELECT count(DISTINCT s) FROM g WHERE p = '{V.SAME_AS}') AS linked
  FROM (SELECT s, count(*) AS n FROM types GROUP BY s))"""))
def enrichment_stats(spark, sf_dir):
    return stats.enrichment_stats(entries(spark, sf_dir))


@query(with_graph(f"""
SELECT nodes, nodes - typed AS untyped, round(tr, 6) AS typed_rate, round(co, 6) AS completeness, round(cn, 6) AS connectivity, round((tr + co + cn) / 3, 6) AS overall FROM (
  SELECT nodes, typed, typed * 100.0::DOUBLE / nodes AS tr, complete * 100.0::DOUBLE / typed AS co, least(100.0::DOUBLE, mean * 10) AS cn FROM (
    SELECT count(*) AS nodes, count(t.e) AS typed, count(*) FILTER (WHERE t.e IS NOT NULL AND l.s IS NOT NULL) AS complete, avg(coalesce(d.degree, 0)) AS mean
    FROM (SELECT s AS e FROM g UNION SELECT o FROM ({_EDGES})) n LEFT JOIN (SELECT DISTINCT s AS e FROM types) t ON n.e = t.e LEFT JOIN ({_LABELS}) l ON n.e = l.s LEFT JOIN ({_DEGREES}) d ON n.e = d.e))"""))
def quality_scores(spark, sf_dir):
    return stats.quality_scores(entries(spark, sf_dir))


def _distribution_sql(counts: str) -> str:
    return f"""SELECT count(*) AS groups, max(n) AS max_n, min(n) AS min_n, round(avg(n), 6) AS avg_n, round(stddev_pop(n), 6) AS std_n, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 1000) AS over_1000, (list_sort(list(n)))[(count(*) // 2)::BIGINT + 1] AS upper_median FROM ({counts})"""


@query(with_graph(_distribution_sql(f"SELECT p, count(*) AS n FROM g WHERE p NOT IN ({', '.join(repr(p) for p in V.STRUCTURAL)}) GROUP BY p"), instances=True))
def property_distribution(spark, sf_dir):
    return stats.distribution(stats.property_usage(graph(spark, sf_dir)))


@query(with_graph(_distribution_sql("SELECT t, count(*) AS n FROM types GROUP BY t"), instances=True))
def class_distribution(spark, sf_dir):
    return stats.distribution(stats.class_counts(graph(spark, sf_dir)))


def _rank_sql(p: str, cls: str | None = None) -> str:
    only = f" AND o IN (SELECT s FROM types WHERE t = '{cls}')" if cls else ""
    return with_graph(f"SELECT e, coalesce(label, {_TAIL.format('e')}) AS label, n FROM (SELECT o AS e, count(*) AS n FROM g WHERE p = '{p}'{only} GROUP BY o ORDER BY n DESC, e LIMIT 20) LEFT JOIN ({_LABELS}) l ON e = l.s")


@query(_rank_sql(V.PART_OF_SERIES))
def series_rank(spark, sf_dir):
    return stats.object_ranking(entries(spark, sf_dir), V.PART_OF_SERIES)


@query(_rank_sql(V.HAS_TAG))
def tag_rank(spark, sf_dir):
    return stats.object_ranking(entries(spark, sf_dir), V.HAS_TAG)


@query(_rank_sql(V.HAS_MEME_TYPE))
def format_rank(spark, sf_dir):
    return stats.object_ranking(entries(spark, sf_dir), V.HAS_MEME_TYPE)


@query(_rank_sql(V.MENTIONS, V.PERSON))
def mention_rank(spark, sf_dir):
    return stats.object_ranking(entries(spark, sf_dir), V.MENTIONS, V.PERSON)


@query(with_graph(f"SELECT * FROM (SELECT p, o, n, row_number() OVER (PARTITION BY p ORDER BY n DESC, o) AS rank, count(*) OVER (PARTITION BY p) AS objects FROM (SELECT p, o, count(*) AS n FROM ({_EDGES}) GROUP BY p, o)) WHERE rank <= 3"))
def per_property_topn(spark, sf_dir):
    return stats.per_property_topn(entries(spark, sf_dir))


_ONTOLOGY = [
    (V.HAS_TAG, V.DOMAIN, V.MEME), (V.HAS_TAG, V.RANGE, V.TAG), (V.PART_OF_SERIES, V.DOMAIN, V.MEME), (V.MENTIONS, V.DOMAIN, V.EVENT), (V.BELONGS_TO, V.DOMAIN, V.PERSON), (V.HAS_BADGE, V.DOMAIN, "kg:Entry"),
    *((t, V.SUBCLASS, "kg:Entry") for t in V.ENTRIES),
]
_ONTOLOGY_SQL = "ont AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in _ONTOLOGY) + ") x(s, p, o))"


def ontology(spark: SparkSession) -> DataFrame:
    """The vocabulary's declared domains, ranges and classes, as triples."""
    rows = spark.createDataFrame(_ONTOLOGY, "s string, p string, o string")
    return rows.select("*", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))


def _typed_uses(side: str) -> str:
    uses = f"SELECT * FROM g WHERE p NOT IN ({', '.join(repr(p) for p in V.STRUCTURAL)})"
    if side == "domain":
        return f"SELECT p, t AS class FROM ({uses}) u JOIN types USING (s)"
    return f"SELECT p, t AS class FROM ({uses}) u JOIN types ON u.o = types.s WHERE o_kind = 'iri' UNION ALL SELECT p, CASE WHEN p IN ('{V.VIEWS}', '{V.COMMENTS}', '{V.ID}') THEN '{V.INTEGER}' WHEN p = '{V.YEAR}' THEN '{V.GYEAR}' ELSE '{V.STRING}' END FROM ({uses}) WHERE o_kind <> 'iri'"


def _inference_body(side: str) -> str:
    declared = f"SELECT s AS p, min(o) AS class FROM ont WHERE p = '{V.DOMAIN if side == 'domain' else V.RANGE}' GROUP BY s"
    return f"""SELECT p, class, round(n / total::DOUBLE, 6) AS share, n, others, 'inferred' AS source FROM (
  SELECT p, max(class) FILTER (WHERE i = 1) AS class, max(n) FILTER (WHERE i = 1) AS n, max(total)::BIGINT AS total, coalesce(string_agg(class, ',' ORDER BY i) FILTER (WHERE i BETWEEN 2 AND 4), '') AS others
  FROM (SELECT *, sum(n) OVER (PARTITION BY p) AS total, row_number() OVER (PARTITION BY p ORDER BY n DESC, class) AS i FROM (SELECT p, class, count(*) AS n FROM ({_typed_uses(side)}) GROUP BY p, class)) GROUP BY p)
WHERE total >= 3 AND n >= 0.7::DOUBLE * total AND p NOT IN (SELECT p FROM ({declared}))
UNION ALL SELECT p, class, 1.0::DOUBLE, NULL, '', 'explicit' FROM ({declared})"""


def _inference_sql(side: str) -> str:
    return with_graph(_inference_body(side), extra=_ONTOLOGY_SQL)


@query(_inference_sql("domain"))
def domain_inference(spark, sf_dir):
    return stats.inferred_classes(entries(spark, sf_dir).unionByName(ontology(spark)), "domain")


@query(_inference_sql("range"))
def range_inference(spark, sf_dir):
    return stats.inferred_classes(entries(spark, sf_dir).unionByName(ontology(spark)), "range")


def _overlapping(triples: DataFrame) -> DataFrame:
    """Further types that make classes overlap: of people, one in ten is a tag and the others are fans."""
    n = F.substring_index("s", "/", -1).try_cast("long")
    people = patterns.subjects(triples, V.TYPE, V.PERSON)
    return triples.unionByName(melt(people.filter(n % 10 != 0), F.col("s"), iri(V.TYPE, "kg:Fan"))).unionByName(melt(people.filter(n % 10 == 0), F.col("s"), iri(V.TYPE, V.TAG)))


_OVERLAP = f"SELECT s, t FROM types UNION ALL SELECT s, CASE WHEN regexp_extract(s, '[0-9]+$')::BIGINT % 10 <> 0 THEN 'kg:Fan' ELSE '{V.TAG}' END FROM types WHERE t = '{V.PERSON}'"


@query(with_graph("""
SELECT a.sub, a.super, a.shared, round(a.shared / n::DOUBLE, 6) AS share, a.shared / n::DOUBLE > 0.8 AS kept, 'inferred' AS source
FROM (SELECT x.t AS sub, y.t AS super, count(*) AS shared FROM ot x JOIN ot y ON x.s = y.s AND x.t <> y.t GROUP BY 1, 2) a JOIN (SELECT t, count(*) AS n FROM ot GROUP BY t) c ON a.sub = c.t
WHERE n >= 3 AND a.shared / n::DOUBLE > 0.5
UNION ALL SELECT s, o, NULL, 1.0::DOUBLE, true, 'explicit' FROM ont WHERE p = 'rdfs:subClassOf'""", extra=_ONTOLOGY_SQL + f", ot AS ({_OVERLAP})"))
def class_overlap(spark, sf_dir):
    return stats.class_overlap(_overlapping(entries(spark, sf_dir)).unionByName(ontology(spark)))


@query(with_graph(f"""
SELECT p, domain, uses, violations, round(violations / uses::DOUBLE, 6) AS rate FROM (
  SELECT p, domain, count(*) AS uses, count(*) FILTER (WHERE typed AND NOT fine) AS violations FROM (
    SELECT u.p, d.o AS domain, EXISTS (SELECT 1 FROM types t WHERE t.s = u.s) AS typed,
      EXISTS (SELECT 1 FROM types t WHERE t.s = u.s AND (t.t = d.o OR t.t = '{V.TAG}' OR t.t IN (SELECT s FROM ont WHERE p = '{V.SUBCLASS}' AND o = d.o))) AS fine
    FROM g u JOIN ont d ON d.s = u.p AND d.p = '{V.DOMAIN}') GROUP BY p, domain)
WHERE uses > 10 AND violations / uses::DOUBLE > 0.5""", extra=_ONTOLOGY_SQL))
def domain_violations(spark, sf_dir):
    return stats.domain_violations(entries(spark, sf_dir).unionByName(ontology(spark)))


@query(with_graph(f"SELECT types, count(*) AS nodes, types IN ('kg:Entity,kg:Tag', 'kg:Series,kg:Tag', 'kg:MemeEntry,kg:Tag', 'kg:Entity,kg:MemeEntry') AS expected FROM (SELECT s, string_agg(t, ',' ORDER BY t) AS types, count(*) AS n FROM ({_OVERLAP}) GROUP BY s) WHERE n > 1 GROUP BY types"))
def multi_typed(spark, sf_dir):
    return stats.multi_typed(_overlapping(entries(spark, sf_dir)))


@query(with_graph(f"""
SELECT count(DISTINCT CASE WHEN t = '{V.INSTANCE}' THEN s END) AS instances, count(DISTINCT CASE WHEN t IN ({', '.join(repr(t) for t in V.ENTRIES)}) THEN s END) AS entries,
  count(DISTINCT CASE WHEN t IN ('{V.TAG}', '{V.MEME_TYPE}', '{V.SERIES}', '{V.STATUS}', '{V.BADGE}') THEN s END) AS metadata,
  (SELECT count(DISTINCT s) FROM g WHERE p = '{V.OCR_TEXT}') AS with_text, (SELECT count(DISTINCT o) FROM g WHERE p = '{V.SAME_AS}' AND o LIKE '%wikidata.org%') AS wikidata_nodes, (SELECT count(*) FROM g WHERE p = '{V.SAME_AS}' AND o LIKE '%wikidata.org%') AS wikidata_edges
FROM types""", instances=True))
def provenance(spark, sf_dir):
    return stats.provenance(graph(spark, sf_dir))


@query(with_graph(f"SELECT p, count(*) AS n FROM g WHERE p NOT IN ({', '.join(repr(p) for p in V.STRUCTURAL)}) AND p NOT IN (SELECT s FROM ont WHERE p IN ('{V.DOMAIN}', '{V.RANGE}')) GROUP BY p HAVING count(*) > 5", extra=_ONTOLOGY_SQL))
def undescribed(spark, sf_dir):
    return stats.undescribed(entries(spark, sf_dir).unionByName(ontology(spark)))


@query(with_graph("SELECT kind, name, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY kind), 6) AS percent FROM (SELECT 'class' AS kind, t AS name, count(*) AS n FROM types GROUP BY t UNION ALL SELECT 'property', p, count(*) FROM g GROUP BY p)", instances=True))
def shares(spark, sf_dir):
    return stats.shares(graph(spark, sf_dir))


_PLAIN_OVERLAP = "SELECT x.t AS sub, y.t AS super, count(*) AS shared FROM types x JOIN types y ON x.s = y.s AND x.t <> y.t GROUP BY 1, 2"


@query(with_graph(f"""
SELECT a.sub AS source, a.super AS target, 'subclass' AS kind, round(a.shared / n::DOUBLE, 6) AS weight FROM ({_PLAIN_OVERLAP}) a JOIN (SELECT t, count(*) AS n FROM types GROUP BY t) c ON a.sub = c.t WHERE n >= 3 AND a.shared / n::DOUBLE > 0.7
UNION ALL SELECT s, o, 'subclass', 1.0::DOUBLE FROM ont WHERE p = '{V.SUBCLASS}'
UNION ALL SELECT d.class, r.class, p, round(least(d.share, r.share), 6) FROM (SELECT p FROM g WHERE p NOT IN ({', '.join(repr(x) for x in V.STRUCTURAL)}) GROUP BY p HAVING count(*) > 50) u
  JOIN ({_inference_body("domain")}) d USING (p) JOIN ({_inference_body("range")}) r USING (p) WHERE r.class NOT LIKE 'xsd:%'""", extra=_ONTOLOGY_SQL))
def structure_graph(spark, sf_dir):
    return stats.structure_graph(entries(spark, sf_dir).unionByName(ontology(spark)))


ENTITY = "nation/7"
_ENTITY_MEMES = f"""SELECT m.meme, l.label, m.kind, m.n_kinds, coalesce(try_cast(v.o AS BIGINT), 0) + 10 * coalesce(try_cast(c.o AS BIGINT), 0) AS engagement
FROM (SELECT meme, arg_max(kind, {_WEIGHT}) AS kind, count(*) AS n_kinds FROM ({_MEME_EDGES}) WHERE e = '{ENTITY}' GROUP BY meme) m
LEFT JOIN ({_LABELS}) l ON l.s = m.meme LEFT JOIN (SELECT * FROM g WHERE p = '{V.VIEWS}') v ON v.s = m.meme LEFT JOIN (SELECT * FROM g WHERE p = '{V.COMMENTS}') c ON c.s = m.meme"""
_TOP_MEMES = f"SELECT * FROM ({_ENTITY_MEMES}) ORDER BY engagement DESC, meme LIMIT 30"
_SECOND = f"""SELECT x.meme, x.kind, x.e, t.t AS type FROM ({_MEME_EDGES}) x JOIN types t ON t.s = x.e WHERE t.t IN ({', '.join(repr(t) for t in V.ENTRIES if t != V.MEME)})
AND x.meme IN (SELECT meme FROM ({_TOP_MEMES})) AND x.e NOT IN (SELECT s FROM types WHERE t = '{V.MEME}')"""


@query(with_graph(_ENTITY_MEMES))
def entity_connections(spark, sf_dir):
    return patterns.entity_connections(entries(spark, sf_dir), ENTITY)


def _top_memes(spark, sf_dir):
    g = entries(spark, sf_dir)
    return g, patterns.entity_connections(g, ENTITY).orderBy(F.desc("engagement"), "meme").limit(30)


@query(with_graph(_SECOND))
def secondary_connections(spark, sf_dir):
    return patterns.secondary_connections(*_top_memes(spark, sf_dir))


@query(with_graph(f"SELECT e, count(DISTINCT CASE WHEN p = '{V.MENTIONS}' THEN meme END) AS n_mentions, count(DISTINCT CASE WHEN p = '{V.HAS_TAG}' THEN meme END) AS n_tags, count(DISTINCT CASE WHEN p = '{V.PART_OF_SERIES}' THEN meme END) AS n_series FROM ({_MEME_EDGES}) GROUP BY e"))
def connection_counts(spark, sf_dir):
    return patterns.connection_counts(entries(spark, sf_dir))


@query(with_graph(f"SELECT c.kind, count(*) AS n, round(avg(nullif(c.engagement, 0)), 6) AS avg_engagement, sum(c.engagement)::BIGINT AS engagement FROM ({_ENTITY_MEMES}) c GROUP BY c.kind"))
def engagement_by_connection(spark, sf_dir):
    rows = patterns.entity_connections(entries(spark, sf_dir), ENTITY)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.nullif("engagement", F.lit(0))), 6).alias("avg_engagement"), F.sum("engagement").alias("engagement"))


@query(with_graph(f"""SELECT y.o::INTEGER AS year, count(*) FILTER (WHERE x.p = '{V.MENTIONS}') AS mentions, count(*) FILTER (WHERE x.p = '{V.HAS_STATUS}') AS "hasStatus", count(*) FILTER (WHERE x.p = '{V.BELONGS_TO}') AS "belongsTo"
FROM g x JOIN g y ON x.s = y.s AND y.p = '{V.YEAR}' WHERE x.p IN ('{V.MENTIONS}', '{V.HAS_STATUS}', '{V.BELONGS_TO}') GROUP BY 1"""))
def connection_by_year_pivot(spark, sf_dir):
    g = entries(spark, sf_dir)
    years = patterns.match(g, p=V.YEAR).select("s", F.col("o").try_cast("int").alias("year"))
    kinds = ["mentions", "hasStatus", "belongsTo"]
    rows = patterns.match(g, p=[V.MENTIONS, V.HAS_STATUS, V.BELONGS_TO]).select("s", F.substring_index("p", ":", -1).alias("kind"))
    return rows.join(years, "s").groupBy("year").pivot("kind", kinds).count().fillna(0)


_PAIRS = f"SELECT DISTINCT meme, e FROM ({_MEME_EDGES})"


@query(with_graph(f"SELECT a.e AS e1, b.e AS e2, count(*) AS shared FROM k a JOIN k b ON a.meme = b.meme AND a.e <> b.e GROUP BY 1, 2", extra=f"pairs AS ({_PAIRS}), top AS (SELECT e FROM pairs GROUP BY e ORDER BY count(*) DESC, e LIMIT 10), k AS (SELECT * FROM pairs WHERE e IN (SELECT e FROM top))"))
def cooccurrence(spark, sf_dir):
    return patterns.cooccurrence(patterns.connections(entries(spark, sf_dir)))


@query(with_graph(f"SELECT kind || '>' || regexp_extract(type, '[^:]*$') AS path, count(*) AS n, count(DISTINCT e) AS entities FROM ({_SECOND}) GROUP BY 1"))
def pathways(spark, sf_dir):
    rows = patterns.secondary_connections(*_top_memes(spark, sf_dir))
    return rows.groupBy(F.concat("kind", F.lit(">"), F.substring_index("type", ":", -1)).alias("path")).agg(F.count("*").alias("n"), F.count_distinct("e").alias("entities"))


@query(with_graph(f"""SELECT source, target, weight FROM (
SELECT '{ENTITY}' AS source, meme AS target, round(greatest(engagement / 1e6, 0.3::DOUBLE), 6) AS weight FROM m20
UNION ALL SELECT DISTINCT meme, e, 0.3::DOUBLE FROM s2 WHERE e IN (SELECT e FROM s2 GROUP BY e ORDER BY count(DISTINCT meme) DESC, e LIMIT 12))""", extra=f"m20 AS (SELECT * FROM ({_TOP_MEMES}) ORDER BY engagement DESC, meme LIMIT 20), s2 AS (SELECT * FROM ({_SECOND}) WHERE meme IN (SELECT meme FROM m20))"))
def meme_network(spark, sf_dir):
    g, top = _top_memes(spark, sf_dir)
    return lineage.network(top, patterns.secondary_connections(g, top), ENTITY)


@query(with_graph(f"""SELECT s, max(o) FILTER (WHERE p = '{V.LABEL}') AS label, max(o) FILTER (WHERE p = '{V.ID}') AS id, max(o) FILTER (WHERE p = '{V.VIEWS}') AS views, max(o) FILTER (WHERE p = '{V.HAS_TAG}') AS tag FROM g WHERE p IN ('{V.LABEL}', '{V.ID}', '{V.VIEWS}', '{V.HAS_TAG}') AND s IN (SELECT s FROM types WHERE t = '{V.MEME}') GROUP BY s"""))
def star_pivot(spark, sf_dir):
    g = entries(spark, sf_dir)
    return patterns.star(g, {"label": V.LABEL, "id": V.ID, "views": V.VIEWS, "tag": V.HAS_TAG}, patterns.subjects(g, V.TYPE, V.MEME))


@query(with_graph(f"SELECT a.s AS order_, b.o AS person, c.o AS nation, l.o AS label FROM g a JOIN g b ON a.s = b.s AND b.p = '{V.BELONGS_TO}' JOIN g c ON c.s = b.o AND c.p = '{V.PART_OF_SERIES}' LEFT JOIN g l ON l.s = c.o AND l.p = '{V.LABEL}' WHERE a.p = '{V.HAS_STATUS}' AND a.o = 'status/p'"))
def pattern_join(spark, sf_dir):
    g = entries(spark, sf_dir)
    rows = patterns.bgp(g, ("?order_", V.HAS_STATUS, "status/p"), ("?order_", V.BELONGS_TO, "?person"), ("?person", V.PART_OF_SERIES, "?nation"))
    return patterns.optional(rows, patterns.bgp(g, ("?nation", V.LABEL, "?label"))).select("order_", "person", "nation", "label")


@query(with_graph(f"SELECT s, min(o) AS label FROM g WHERE p = '{V.LABEL}' AND s IN (SELECT s FROM types WHERE t = '{V.PERSON}') AND s NOT IN (SELECT s FROM g WHERE p = '{V.SAME_AS}') GROUP BY s"))
def unlinked_people(spark, sf_dir):
    g = entries(spark, sf_dir)
    return patterns.having(patterns.having(patterns.labels(g), g, V.TYPE, V.PERSON), g, V.SAME_AS, negate=True)


@query(with_graph(f"SELECT g.s, g.o AS label FROM g WHERE p = '{V.LABEL}' AND lower(o) LIKE '%bolt%' AND s IN (SELECT s FROM types WHERE t IN ({', '.join(repr(t) for t in V.ENTRIES)})) ORDER BY label, s LIMIT 20"))
def find_label(spark, sf_dir):
    return patterns.find_label(entries(spark, sf_dir), "BOLT", 20)


_HOPS = f"""ends AS MATERIALIZED (SELECT s AS a, o AS b FROM ({_EDGES}) UNION ALL SELECT o, s FROM ({_EDGES})),
typed AS MATERIALIZED (SELECT DISTINCT s AS e FROM types),
h1 AS MATERIALIZED (SELECT DISTINCT b AS e FROM ends JOIN typed ON typed.e = b WHERE a = 'supplier/1' AND b <> 'supplier/1'),
h2 AS MATERIALIZED (SELECT DISTINCT b AS e FROM ends JOIN h1 ON h1.e = a JOIN typed ON typed.e = b WHERE b <> 'supplier/1' EXCEPT SELECT e FROM h1),
reached AS MATERIALIZED (SELECT 'supplier/1' AS e, 0 AS depth UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2)"""


def _reached(spark, sf_dir):
    g = entries(spark, sf_dir)
    return g, traversal.k_hop(g, spark.createDataFrame([("supplier/1",)], "e string"), 2)


@query(with_graph("SELECT * FROM reached", extra=_HOPS))
def k_hop_subgraph(spark, sf_dir):
    return _reached(spark, sf_dir)[1]


@query(with_graph(f"SELECT s, p, o FROM ({_EDGES}) x JOIN reached a ON a.e = x.s AND a.depth < 2 JOIN reached b ON b.e = x.o AND b.depth < 2", extra=_HOPS))
def subgraph_edges(spark, sf_dir):
    g, reached = _reached(spark, sf_dir)
    return traversal.subgraph(g, reached.filter("depth < 2"))


@query(with_graph("SELECT t AS type, count(DISTINCT e) AS nodes FROM reached JOIN types ON s = e GROUP BY t", extra=_HOPS))
def subgraph_types(spark, sf_dir):
    return traversal.nodes_by_type(*_reached(spark, sf_dir))


@query(with_graph("SELECT s, p, o, o_kind FROM g JOIN i USING (s)", instances=True, extra=f"i AS MATERIALIZED (SELECT DISTINCT s FROM types WHERE t = '{V.INSTANCE}')"))
def instance_subgraph(spark, sf_dir):
    return traversal.instance_subgraph(graph(spark, sf_dir)).select("s", "p", "o", "o_kind")


_BARE = "SELECT s FROM g WHERE s NOT IN (SELECT s FROM types)"
_LABELLED_ONLY = f"g2 AS (SELECT s, p, o FROM g WHERE NOT (p = '{V.TYPE}' AND o = '{V.TAG}'))"


@query(with_graph(f"SELECT count(DISTINCT s) AS entities, count(*) AS triples FROM g2 WHERE s NOT IN (SELECT s FROM g2 WHERE p = '{V.TYPE}')", extra=_LABELLED_ONLY))
def untyped(spark, sf_dir):
    return stats.untyped(entries(spark, sf_dir).filter((F.col("p") != V.TYPE) | (F.col("o") != V.TAG)))


@query(with_graph("SELECT p FROM (SELECT p FROM g UNION ALL SELECT * FROM (VALUES ('kg:odd'), ('kg:hasOdd'), ('kg:yearOdd'), ('kg:twice'), ('kg:twice')) v(p)) WHERE p LIKE 'kg:%' GROUP BY p HAVING count(*) = 1 AND NOT regexp_matches(regexp_extract(p, '[^/#:]*$'), '^(has|is)[A-Z]|^(date|year|time)|[Cc]ount$|^same')"))
def singleton_properties(spark, sf_dir):
    odd = spark.createDataFrame([(p,) for p in ("kg:odd", "kg:hasOdd", "kg:yearOdd", "kg:twice", "kg:twice")], "p string")
    rows = odd.select(F.lit("x").alias("s"), "p", F.lit("y").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    return stats.singletons(entries(spark, sf_dir).unionByName(rows))


@query(with_graph("SELECT p, count(*) AS values, min(o) AS example FROM g WHERE s = 'customer/7' GROUP BY p"))
def entity_card(spark, sf_dir):
    return stats.entity_card(entries(spark, sf_dir), "customer/7")


_ALL = f"a AS MATERIALIZED (SELECT s, p, o FROM g UNION ALL SELECT s, '{V.TYPE}', CASE WHEN regexp_extract(s, '[0-9]+$')::BIGINT % 10 <> 0 THEN 'kg:Fan' ELSE '{V.TAG}' END FROM types WHERE t = '{V.PERSON}' UNION ALL SELECT s, p, o FROM ont), kinds AS MATERIALIZED (SELECT s, o AS t FROM a WHERE p = '{V.TYPE}')"


@query(with_graph(f"""
SELECT 'type_combinations' AS issue, count(*) AS n FROM (SELECT DISTINCT types FROM (SELECT s, string_agg(t, ',' ORDER BY t) AS types, count(*) AS n FROM kinds GROUP BY s) WHERE n > 1 AND types NOT IN ('kg:Entity,kg:Tag', 'kg:Series,kg:Tag', 'kg:MemeEntry,kg:Tag', 'kg:Entity,kg:MemeEntry'))
UNION ALL SELECT 'domain_violations', count(*) FROM (SELECT p, domain, count(*) AS uses, count(*) FILTER (WHERE typed AND NOT fine) AS bad FROM (
  SELECT u.p, d.o AS domain, y.s IS NOT NULL AS typed, f.s IS NOT NULL AS fine FROM a u JOIN ont d ON d.s = u.p AND d.p = '{V.DOMAIN}' LEFT JOIN (SELECT DISTINCT s FROM kinds) y ON y.s = u.s
  LEFT JOIN (SELECT DISTINCT kinds.s, dom.o AS domain FROM kinds, (SELECT DISTINCT o FROM ont WHERE p = '{V.DOMAIN}') dom WHERE t = dom.o OR t = '{V.TAG}' OR EXISTS (SELECT 1 FROM ont z WHERE z.p = '{V.SUBCLASS}' AND z.s = t AND z.o = dom.o)) f ON f.s = u.s AND f.domain = d.o) GROUP BY p, domain) WHERE uses > 10 AND bad / uses::DOUBLE > 0.5
UNION ALL SELECT 'singleton_properties', count(*) FROM (SELECT p FROM a WHERE p NOT IN ({', '.join(repr(x) for x in V.STRUCTURAL)}) GROUP BY p HAVING count(*) = 1 AND NOT regexp_matches(regexp_extract(p, '[^/#:]*$'), '^(has|is)[A-Z]|^(date|year|time)|[Cc]ount$|^same'))
UNION ALL SELECT 'untyped_entities', count(DISTINCT s) FROM a WHERE s NOT IN (SELECT s FROM kinds)""", extra=_ONTOLOGY_SQL + ", " + _ALL))
def anomalies(spark, sf_dir):
    return stats.anomalies(_overlapping(entries(spark, sf_dir)).unionByName(ontology(spark)))


@query(with_graph(f"SELECT g.s, o AS label, t AS type FROM g JOIN types USING (s) WHERE p = '{V.LABEL}' AND o = 'Supplier#000000003' AND t IN ({', '.join(repr(t) for t in V.ENTRIES)}) ORDER BY s, t LIMIT 1"))
def exact_label(spark, sf_dir):
    return patterns.exact_label(entries(spark, sf_dir), "Supplier#000000003")


@query(with_graph(f"SELECT s, label FROM (SELECT s, min(o) AS label FROM g WHERE p = '{V.LABEL}' GROUP BY s) WHERE s IN (SELECT s FROM types WHERE t = '{V.PERSON}') ORDER BY label, s LIMIT 20"))
def sample_entities(spark, sf_dir):
    return patterns.sample_entities(entries(spark, sf_dir), V.PERSON)


@query(with_graph(f"""SELECT e, count(*) AS n, count(DISTINCT x.meme) AS memes, string_agg(DISTINCT type, ',' ORDER BY type) AS types, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, sum(engagement)::BIGINT AS engagement
FROM ({_SECOND}) x JOIN ({_TOP_MEMES}) m ON m.meme = x.meme GROUP BY e""".replace("x.meme, x.kind, x.e, t.t AS type", "x.meme, x.kind, x.e, t.t AS type").replace("string_agg(DISTINCT kind", "string_agg(DISTINCT x.kind").replace("ORDER BY kind", "ORDER BY x.kind")))
def connection_totals(spark, sf_dir):
    g, top = _top_memes(spark, sf_dir)
    return patterns.connection_totals(patterns.secondary_connections(g, top), top)


@query(with_graph(f"SELECT p, count(*) AS n FROM g WHERE p LIKE 'kg:%' GROUP BY p ORDER BY n DESC, p LIMIT 10", instances=True))
def top_properties(spark, sf_dir):
    return stats.top_properties(graph(spark, sf_dir))


@query(with_graph("SELECT 'class' AS category, t AS metric, count(*)::DOUBLE AS value FROM types GROUP BY t UNION ALL SELECT 'property', p, count(*)::DOUBLE FROM g WHERE p NOT IN (" + ", ".join(repr(p) for p in V.STRUCTURAL) + f") GROUP BY p UNION ALL SELECT 'connected', e, degree::DOUBLE FROM (SELECT e, degree FROM ({_DEGREES}) ORDER BY degree DESC, e LIMIT 5) UNION ALL SELECT 'structure', 'triples', count(*)::DOUBLE FROM g UNION ALL SELECT 'structure', 'edges', count(*) FILTER (WHERE o_kind = 'iri')::DOUBLE FROM g UNION ALL SELECT 'undescribed', p, count(*)::DOUBLE FROM g WHERE p NOT IN (" + ", ".join(repr(p) for p in V.STRUCTURAL) + f") AND p NOT IN (SELECT s FROM ont WHERE p IN ('{V.DOMAIN}', '{V.RANGE}')) GROUP BY p HAVING count(*) > 5", extra=_ONTOLOGY_SQL))
def analysis_report(spark, sf_dir):
    return stats.analysis_report(entries(spark, sf_dir), ontology(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in TERMS) + ") x(s, p, o)")
def vocabulary(spark, sf_dir):
    return vocabulary_triples(spark).select("s", "p", "o")
