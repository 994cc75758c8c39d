"""Statistics, inference and quality checks of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import local_name
from ..session import cut, spread
from .patterns import labels, match, subjects, types

_count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))


def class_counts(triples: DataFrame) -> DataFrame:
    return match(triples, p=V.TYPE).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def property_usage(triples: DataFrame) -> DataFrame:
    """Uses of each predicate that relates or describes entities, and whether it is of the vocabulary."""
    return triples.filter(~F.col("p").isin(*V.STRUCTURAL)).groupBy("p").agg(F.count("*").alias("n")).withColumn("own", F.col("p").startswith("kg:"))


def endpoints(triples: DataFrame) -> DataFrame:
    """(e, out, in): both ends of every edge between nodes, types left out."""
    edges = triples.filter((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE))
    ends = F.array(F.struct(F.col("s").alias("e"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("o").alias("e"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def graph_structure(triples: DataFrame) -> DataFrame:
    """Counts of triples, edges and distinct terms: each term is shuffled by itself, a long one as its digest.

    Objects repeat, and are made distinct first; subjects hardly repeat in a file of a store.
    """
    iri = F.col("o_kind") == "iri"
    term = lambda c: F.when(F.length(c) > 64, F.concat(F.lit("\0"), F.sha2(c, 256))).otherwise(F.col(c)).alias("t")  # noqa: E731 - longer than 64 itself, so no short term
    objects = triples.select(term("o"), F.when(iri, 1).otherwise(2).alias("k")).distinct()
    per = spread(triples.select(term("s"), F.lit(0).alias("k")).unionByName(objects), "t", rows=2 * triples.count()).groupBy("t").agg(*(F.max((F.col("k") == k).cast("int")).alias(f"k{k}") for k in range(3)))
    distinct = per.agg(*(F.coalesce(F.sum(f"k{k}"), F.lit(0)).cast("long").alias(c) for k, c in enumerate(("subjects", "iri_objects", "literal_objects"))), _count((F.col("k0") == 1) | (F.col("k1") == 1)).alias("nodes"))
    edges = triples.agg(F.count("*").alias("triples"), _count(iri).alias("edges"), _count(~iri).alias("literal_triples"))
    return edges.crossJoin(distinct).withColumn("iri_percent", F.round(F.try_divide(F.col("edges") * 100.0, "triples"), 6))


FAMILIES = [("rdf:", "rdf"), ("rdfs:", "rdfs"), ("owl:", "owl"), ("kg:", "kg")]


def relation_families(triples: DataFrame) -> DataFrame:
    family = F.lit("other")
    for prefix, name in FAMILIES:
        family = F.when(F.col("p").startswith(prefix), name).otherwise(family)
    return triples.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_distinct("p").alias("predicates"), _count(F.col("o_kind") == "iri").alias("edges"))


def entity_degrees(triples: DataFrame) -> DataFrame:
    return endpoints(triples).groupBy("e").agg(F.sum("out").cast("long").alias("out_degree"), F.sum("in").cast("long").alias("in_degree"), F.count("*").alias("degree"))


def degree_stats(triples: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Of the typed entities: their number, mean, largest and least degrees, and how many have no edge."""
    typed = types(triples).select(F.col("s").alias("e")).distinct()
    if prefixes:
        typed = typed.filter(F.exists(F.array(*map(F.lit, prefixes)), lambda x: F.col("e").startswith(x)))
    d = typed.join(entity_degrees(triples), "e", "left").fillna(0)
    return d.agg(
        F.count("*").alias("entities"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.avg("out_degree"), 6).alias("avg_out"), F.round(F.avg("in_degree"), 6).alias("avg_in"),
        F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), _count(F.col("degree") == 0).alias("isolated"),
    )


def density(triples: DataFrame) -> DataFrame:
    """Edges over n(n-1), in percent, its complement, and edges and triples a node."""
    iri = F.col("o_kind") == "iri"
    nodes = triples.select(F.explode(F.when(iri, F.array("s", "o")).otherwise(F.array("s"))).alias("t")).distinct().agg(F.count("*").alias("nodes"))
    g = triples.agg(F.count("*").alias("triples"), _count(iri).alias("edges")).crossJoin(nodes)
    n = F.col("nodes").cast("double")
    share = F.coalesce(F.try_divide(F.col("edges") * 100.0, n * (n - 1)), F.lit(0.0))
    return g.select("nodes", "edges", F.round(share, 9).alias("density_percent"), F.round(100 - share, 9).alias("sparsity_percent"), F.round(F.try_divide(F.col("edges"), n), 6).alias("edges_per_node"), F.round(F.try_divide(F.col("triples"), n), 6).alias("triples_per_node"))


def most_connected(triples: DataFrame, n: int = 20) -> DataFrame:
    return entity_degrees(triples).select("e", "degree").orderBy(F.desc("degree"), "e").limit(n)


def distribution(counts: DataFrame) -> DataFrame:
    """Of the column ``n``: extremes, mean, population deviation, upper median, and how many are 1 or over 1000."""
    middle = counts.withColumn("i", F.row_number().over(Window.orderBy("n"))).crossJoin(counts.agg(F.count("*").alias("c"))).filter(F.col("i") == F.floor(F.col("c") / 2) + 1).agg(F.max("n").alias("upper_median"))
    return counts.agg(
        F.count("*").alias("groups"), F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.round(F.avg("n"), 6).alias("avg_n"), F.round(F.stddev_pop("n"), 6).alias("std_n"),
        _count(F.col("n") == 1).alias("singletons"), _count(F.col("n") > 1000).alias("over_1000"),
    ).crossJoin(middle)


def temporal_coverage(triples: DataFrame) -> DataFrame:
    return match(triples, p=[V.YEAR, V.DATE_CREATED, V.TEMPORAL]).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("entities"))


def enrichment_stats(triples: DataFrame) -> DataFrame:
    """Links to other graphs, and entities of more than one type."""
    per = spread(types(triples), "s").groupBy("s").agg(F.count("*").alias("n"))
    typed = per.agg(F.count("*").alias("entities"), _count(F.col("n") > 1).alias("multi_typed"))
    links = match(triples, p=V.SAME_AS).agg(_count(F.col("o").contains("wikidata.org")).alias("wikidata_links"), _count(~F.col("o").contains("wikidata.org")).alias("other_links"), F.count_distinct("s").alias("linked"))
    return typed.crossJoin(links).withColumn("link_rate", F.round(F.try_divide(F.col("linked") * 100.0, "entities"), 6)).withColumn("multi_typed_rate", F.round(F.try_divide(F.col("multi_typed") * 100.0, "entities"), 6))


def quality_scores(triples: DataFrame) -> DataFrame:
    """Shares of nodes with a type and of typed ones with a label, connectivity from the mean degree, and their mean."""
    typed = types(triples).select(F.col("s").alias("e")).distinct().withColumn("typed", F.lit(1))
    labelled = labels(triples).select(F.col("s").alias("e"), F.lit(1).alias("labelled"))
    nodes = triples.select(F.col("s").alias("e")).unionByName(triples.filter((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE)).select(F.col("o").alias("e"))).distinct()
    d = nodes.join(typed, "e", "left").join(labelled, "e", "left").join(entity_degrees(triples).select("e", "degree"), "e", "left")
    a = d.agg(F.count("*").alias("nodes"), F.count("typed").alias("typed"), _count(F.col("typed").isNull()).alias("untyped"), _count((F.col("typed") == 1) & (F.col("labelled") == 1)).alias("complete"), F.avg(F.coalesce("degree", F.lit(0))).alias("mean"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x) * 100.0, F.col(y)), F.lit(0.0))
    scores = a.select("nodes", "untyped", rate("typed", "nodes").alias("typed_rate"), rate("complete", "typed").alias("completeness"), F.least(F.lit(100.0), F.coalesce(F.col("mean"), F.lit(0.0)) * 10).alias("connectivity"))
    return scores.withColumn("overall", (F.col("typed_rate") + F.col("completeness") + F.col("connectivity")) / 3).select("nodes", "untyped", *(F.round(c, 6).alias(c) for c in ("typed_rate", "completeness", "connectivity", "overall")))


def object_ranking(triples: DataFrame, p: str, cls: str | None = None, n: int = 20) -> DataFrame:
    """The objects of a predicate that most triples have, with their labels."""
    rows = match(triples, p=p).select(F.col("o").alias("e"))
    if cls:
        rows = rows.join(subjects(triples, V.TYPE, cls).withColumnRenamed("s", "e"), "e", "left_semi")
    top = rows.groupBy("e").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "e").limit(n)
    return top.join(labels(triples).withColumnRenamed("s", "e"), "e", "left").select("e", F.coalesce("label", local_name(F.col("e"))).alias("label"), "n")


def per_property_topn(triples: DataFrame, n: int = 3) -> DataFrame:
    """Of each predicate between nodes, its distinct objects and the ``n`` most used."""
    per = triples.filter((F.col("o_kind") == "iri") & (F.col("p") != V.TYPE)).groupBy("p", "o").agg(F.count("*").alias("n"))
    group = Window.partitionBy("p")
    return per.withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "o")).cast("long")).withColumn("objects", F.count("*").over(group)).filter(F.col("rank") <= n)


def inferred_classes(triples: DataFrame, side: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """(p, class, share, n, source): the domain or range of each predicate.

    An explicit declaration wins. Otherwise it is the class of most uses, if there are ``least`` uses of
    known class and the class has ``share`` of them. Values count by their datatype when ``side`` is range.
    """
    declared = match(triples, p=V.DOMAIN if side == "domain" else V.RANGE).groupBy(F.col("s").alias("p")).agg(F.min("o").alias("class"))
    uses = triples.filter(~F.col("p").isin(*V.STRUCTURAL))
    ends = uses.select("p", "s") if side == "domain" else uses.filter("o_kind = 'iri'").select("p", F.col("o").alias("s"))
    rows = ends.count()
    # a part holds the types of its nodes and passes the uses of them by, which have no bound: no side is sorted
    typed = spread(ends, "s", rows=rows).join(spread(types(triples), "s", rows=rows).hint("shuffle_hash"), "s").select("p", F.col("t").alias("class"))
    if side == "domain":
        known = typed
    else:
        nodes = typed
        known = nodes.unionByName(uses.filter("o_kind <> 'iri'").select("p", F.coalesce("o_datatype", F.lit(V.STRING)).alias("class")))
    per = known.groupBy("p", "class").agg(F.count("*").alias("n"))
    group = Window.partitionBy("p")
    ranked = per.withColumn("total", F.sum("n").over(group)).withColumn("i", F.row_number().over(group.orderBy(F.desc("n"), "class")))
    found = ranked.groupBy("p").agg(F.max(F.when(F.col("i") == 1, F.col("class"))).alias("class"), F.max(F.when(F.col("i") == 1, F.col("n"))).alias("n"), F.max("total").alias("total"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("i").between(2, 4), F.struct("i", "class")))), lambda x: x["class"])).alias("others"))
    found = found.join(declared.select("p"), "p", "left_anti").filter((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))
    return found.select("p", "class", F.round(F.col("n") / F.col("total"), 6).alias("share"), "n", "others", F.lit("inferred").alias("source")).unionByName(declared.select("p", "class", F.lit(1.0).alias("share"), F.lit(None).cast("long").alias("n"), F.lit("").alias("others"), F.lit("explicit").alias("source")))


def class_overlap(triples: DataFrame, least: int = 3, candidate: float = 0.5, kept: float = 0.8) -> DataFrame:
    """(sub, super, shared, share, kept, source): classes most of whose members another class has; and declared ones."""
    t = cut(types(triples))  # it is read twice
    size = t.groupBy(F.col("t").alias("sub")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    of = spread(t, "s").groupBy("s").agg(F.collect_list("t").alias("ts")).filter(F.size("ts") > 1)  # others share nothing
    both = of.select(F.explode("ts").alias("sub"), "ts").select("sub", F.explode("ts").alias("super")).filter("sub <> super").groupBy("sub", "super").agg(F.count("*").alias("shared"))
    share = F.col("shared") / F.col("n")
    found = both.join(size, "sub").filter(share > candidate).select("sub", "super", "shared", F.round(share, 6).alias("share"), (share > kept).alias("kept"), F.lit("inferred").alias("source"))
    declared = match(triples, p=V.SUBCLASS).select(F.col("s").alias("sub"), F.col("o").alias("super"), F.lit(None).cast("long").alias("shared"), F.lit(1.0).alias("share"), F.lit(True).alias("kept"), F.lit("explicit").alias("source"))
    return found.unionByName(declared)


def domain_violations(triples: DataFrame, least: int = 10, severe: float = 0.5) -> DataFrame:
    """Predicates with a declared domain that over ``severe`` of more than ``least`` uses break.

    A subject of the domain, of a direct subclass, or a tag is in order; an untyped one counts as a use only.
    """
    domain = match(triples, p=V.DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("domain"))
    sub = match(triples, p=V.SUBCLASS).select(F.col("s").alias("t"), F.col("o").alias("domain"))
    fine = domain.select("domain").distinct().select("domain", F.col("domain").alias("t")).unionByName(sub.join(domain.select("domain").distinct(), "domain", "left_semi").select("domain", "t")).distinct()
    uses = triples.select("s", "p").join(domain, "p")
    n = uses.groupBy("p", "domain").agg(F.count("*").alias("uses"))
    # of each subject its uses by predicate, and the domains that its types are fine for: two exchanges by subject
    per = spread(uses, "s").groupBy("s", "p", "domain").agg(F.count("*").alias("u"))
    kinds = types(triples).join(fine.groupBy("t").agg(F.collect_set("domain").alias("domains")), "t", "left")
    kinds = spread(kinds, "s").groupBy("s").agg(F.flatten(F.collect_list(F.coalesce("domains", F.array().cast("array<string>")))).alias("domains"), F.max((F.col("t") == V.TAG).cast("int")).alias("tag"))
    bad = per.join(kinds, "s").filter((F.col("tag") == 0) & ~F.array_contains("domains", F.col("domain"))).groupBy("p", "domain").agg(F.sum("u").cast("long").alias("violations"))
    rate = F.col("violations") / F.col("uses")
    return n.join(bad, ["p", "domain"]).filter((F.col("uses") > least) & (rate > severe)).select("p", "domain", "uses", "violations", F.round(rate, 6).alias("rate"))


def multi_typed(triples: DataFrame, accepted: list[list[str]] | None = None) -> DataFrame:
    """Combinations of types that nodes have, and whether they are expected ones."""
    accepted = [",".join(sorted(x)) for x in (accepted or [[V.TAG, V.ENTITY], [V.TAG, V.SERIES], [V.TAG, V.MEME], [V.ENTITY, V.MEME]])]
    per = spread(types(triples), "s").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"), F.count("*").alias("n")).filter("n > 1")
    return per.groupBy("types").agg(F.count("*").alias("nodes")).withColumn("expected", F.col("types").isin(*accepted))


def provenance(triples: DataFrame) -> DataFrame:
    """Instances, those with text, entries, metadata nodes and links: each is shuffled once, by itself."""
    t = types(triples)
    entry, meta = F.col("t").isin(*V.ENTRIES), F.col("t").isin(V.TAG, V.MEME_TYPE, V.SERIES, V.STATUS, V.BADGE)
    per = spread(t, "s").groupBy("s").agg(F.max((F.col("t") == V.INSTANCE).cast("int")).alias("i"), F.max(entry.cast("int")).alias("e"), F.max(meta.cast("int")).alias("m"))
    a = per.agg(*(_count(F.col(c) == 1).alias(name) for c, name in (("i", "instances"), ("e", "entries"), ("m", "metadata"))))
    texts = spread(match(triples, p=V.OCR_TEXT).select("s"), "s").distinct().agg(F.count("*").alias("with_text"))
    links = match(triples, p=V.SAME_AS).filter(F.col("o").contains("wikidata.org")).select("o")
    per = spread(links, "o").groupBy("o").agg(F.count("*").alias("n"))
    b = per.agg(F.count("*").alias("wikidata_nodes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("wikidata_edges"))
    return a.crossJoin(texts).crossJoin(b)


def extraction_stats(triples: DataFrame) -> DataFrame:
    """Of each source of extraction: its predicates, their edges and the entities at their ends."""
    marked = match(triples, p=V.EXTRACTED_BY).select(F.col("s").alias("p")).distinct()
    source = match(triples, p=V.SOURCE).select(F.col("s").alias("p"), F.col("o").alias("source")).distinct()
    edges = triples.filter("o_kind = 'iri'").join(marked, "p", "left_semi").join(source, "p", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))
    a = edges.groupBy("source").agg(F.count("*").alias("edges"), F.count_distinct("p").alias("predicates"))
    b = edges.select("source", F.explode(F.array("s", "o")).alias("e")).groupBy("source").agg(F.count_distinct("e").alias("entities"))
    return a.join(b, "source")


def undescribed(triples: DataFrame, n: int = 5) -> DataFrame:
    """Predicates without a declared domain or range that are used more than ``n`` times."""
    known = match(triples, p=[V.DOMAIN, V.RANGE]).select(F.col("s").alias("p")).distinct()
    return property_usage(triples).filter(F.col("n") > n).join(known, "p", "left_anti").select("p", "n")


def shares(triples: DataFrame) -> DataFrame:
    """Each class's share of typed nodes and each predicate's of triples, in percent."""
    everything = Window.partitionBy()
    c = class_counts(triples).select(F.lit("class").alias("kind"), F.col("class").alias("name"), "n")
    p = triples.groupBy("p").agg(F.count("*").alias("n")).select(F.lit("property").alias("kind"), F.col("p").alias("name"), "n")
    part = lambda df: df.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 6))
    return part(c).unionByName(part(p))


def structure_graph(triples: DataFrame, least: int = 50, confidence: float = 0.7) -> DataFrame:
    """(source, target, kind, weight): edges between classes, by overlap and by domain and range of common predicates."""
    classes = class_overlap(triples).filter(F.col("share") > confidence).select(F.col("sub").alias("source"), F.col("super").alias("target"), F.lit("subclass").alias("kind"), F.col("share").alias("weight"))
    used = property_usage(triples).filter(F.col("n") > least).select("p")
    d = inferred_classes(triples, "domain").select("p", F.col("class").alias("source"), F.col("share").alias("a"))
    r = inferred_classes(triples, "range").filter(~F.col("class").startswith("xsd:")).select("p", F.col("class").alias("target"), F.col("share").alias("b"))
    return classes.unionByName(used.join(d, "p").join(r, "p").select("source", "target", F.col("p").alias("kind"), F.round(F.least("a", "b"), 6).alias("weight")))


#: Names that a predicate which is used once may well have.
SINGLE_NAMES = ["^(has|is)[A-Z]", "^(date|year|time)", "[Cc]ount$", "^same"]


def singletons(triples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Predicates that are used once and have none of the usual names."""
    usual = F.lit(False)
    for n in SINGLE_NAMES if names is None else names:
        usual = usual | local_name(F.col("p")).rlike(n)
    return property_usage(triples).filter((F.col("n") == 1) & ~usual).select("p")


def untyped(triples: DataFrame, prefix: str = "") -> DataFrame:
    """Nodes without a type: those that have triples, and the triples that they have."""
    # a subject's triples are counted in the part that has its types: one exchange, no join
    rows = triples.filter(F.col("s").startswith(prefix)).select("s", (F.col("p") == V.TYPE).cast("int").alias("typed"))
    per = spread(rows, "s").groupBy("s").agg(F.max("typed").alias("typed"), F.count("*").alias("n")).filter("typed = 0")
    return per.agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triples"))


def anomalies(triples: DataFrame) -> DataFrame:
    """(issue, n): how many cases of each kind of anomaly there are."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    return (
        one(multi_typed(triples).filter("not expected"), "type_combinations").unionByName(one(domain_violations(triples), "domain_violations"))
        .unionByName(one(singletons(triples), "singleton_properties")).unionByName(untyped(triples).select(F.lit("untyped_entities").alias("issue"), F.col("entities").alias("n")))
    )


def entity_card(triples: DataFrame, entity: str) -> DataFrame:
    """(p, values, example): what is known of an entity, by predicate."""
    return match(triples, s=entity).groupBy("p").agg(F.count("*").alias("values"), F.min("o").alias("example"))


def top_properties(triples: DataFrame, prefix: str = "kg:", n: int = 10) -> DataFrame:
    """(p, n): the vocabulary's most used predicates."""
    return triples.filter(F.col("p").startswith(prefix)).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(n)


def analysis_report(triples: DataFrame, declared: DataFrame, connected: int = 5) -> DataFrame:
    """(category, metric, value): classes, properties, structure, the most connected nodes and predicates without a description."""
    long = lambda df, category, metric, value: df.select(F.lit(category).alias("category"), F.col(metric).alias("metric"), F.col(value).cast("double").alias("value"))
    sizes = triples.agg(F.count("*").alias("triples"), _count(F.col("o_kind") == "iri").alias("edges")).unpivot([], ["triples", "edges"], "metric", "value")
    return (
        long(class_counts(triples), "class", "class", "n").unionByName(long(property_usage(triples), "property", "p", "n"))
        .unionByName(long(most_connected(triples).orderBy(F.desc("degree"), "e").limit(connected), "connected", "e", "degree")).unionByName(long(sizes, "structure", "metric", "value"))
        .unionByName(long(undescribed(triples.unionByName(declared)), "undescribed", "p", "n"))
    )
