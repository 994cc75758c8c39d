"""Registry, relations and links of entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import label_variants, normalize_label, predicate_name, slug, temporal_predicate
from ..schema import iri, literal, melt
from ..session import cut, spread
from .patterns import match


def registry_types(assertions: DataFrame) -> DataFrame:
    """(slug, type) of asserted nodes, from rows of slug, type, is_entry, r and seq.

    Every entry row adds its type. The first other reference adds its own only if it stands before the slug's
    first entry row, or there is none. This needs one aggregate by slug, and no order of processing.
    """
    at = F.struct("r", "seq")
    per = assertions.groupBy("slug").agg(
        F.collect_set(F.when(F.col("is_entry"), F.col("type"))).alias("own"), F.min(F.when(F.col("is_entry"), at)).alias("entry_at"),
        F.min(F.when(~F.col("is_entry"), at)).alias("aux_at"), F.min_by("type", F.when(~F.col("is_entry"), at)).alias("aux"),
    )
    aux = F.when(F.col("aux_at").isNotNull() & (F.col("entry_at").isNull() | (F.col("aux_at") < F.col("entry_at"))), F.array("aux")).otherwise(F.array().cast("array<string>"))
    return per.select("slug", F.explode(F.array_union("own", aux)).alias("type"))


def prior_type(triples: DataFrame) -> DataFrame:
    """(s, t): the preferred one of each node's types."""
    rank = F.array_position(F.array(*map(F.lit, V.TYPE_ORDER)), F.col("o"))
    return spread(match(triples, p=V.TYPE), "s").groupBy("s").agg(F.min_by("o", F.struct(F.when(rank > 0, rank).otherwise(len(V.TYPE_ORDER) + 1), F.col("o"))).alias("t"))


def relation_triples(relations: DataFrame, source: str) -> DataFrame:
    """Triples of extracted relations, from rows of main, subject, relation and object.

    Terms under two characters are dropped. A temporal relation describes its subject; any other relates two
    entities, which the main entity mentions. Predicates carry the source that they were extracted from.
    """
    rows = cut(relations.filter((F.length(F.trim("subject")) >= 2) & (F.length(F.trim("object")) >= 2)).distinct())  # it is read six times
    rows = rows.withColumn("s", F.concat(F.lit("entity/"), slug(F.col("subject")))).withColumn("o", F.concat(F.lit("entity/"), slug(F.col("object")))).withColumn("time", temporal_predicate(F.col("relation"), F.col("object")))
    pred = F.concat(F.lit("rel:"), predicate_name(F.col("relation")))
    plain = rows.filter("time is null").withColumn("p", pred)
    ends = plain.select("main", F.explode(F.array(F.struct("s", F.col("subject").alias("label")), F.struct(F.col("o").alias("s"), F.col("object").alias("label")))).alias("e")).select("main", "e.*")
    edge = lambda df: df.select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    first = ends.groupBy("s").agg(F.min("label").alias("label"))
    timed = rows.filter("time is not null").select("s", F.col("time").alias("p"), F.col("object").alias("o"), F.lit("literal").alias("o_kind"), F.when(F.col("time") == V.YEAR, V.GYEAR).otherwise(V.STRING).alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    return (
        edge(plain.select("s", "p", "o").distinct())
        .unionByName(melt(first, F.col("s"), iri(V.TYPE, V.ENTITY), literal(V.LABEL, F.col("label"))))
        .unionByName(edge(ends.select(F.col("main").alias("s"), F.lit(V.MENTIONS).alias("p"), F.col("s").alias("o")).distinct()))
        .unionByName(melt(plain.select("p").distinct(), F.col("p"), literal(V.EXTRACTED_BY, "extractor"), literal(V.SOURCE, source)))
        .unionByName(timed.distinct())
    )


def link_labels(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, id, via): the dictionary entry of each name, by the first of its variants that is a label, else an alias.

    ``dictionary`` has id, label and src, 0 for labels and 1 for aliases; each distinct name is looked up once.
    """
    variants = names.select("name").distinct().select("name", F.posexplode(label_variants(normalize_label(F.col("name")))).alias("rank", "label"))
    known = dictionary.groupBy("label", "src").agg(F.min("id").alias("id"))
    best = variants.join(known, "label").groupBy("name").agg(F.min(F.struct("src", "rank", "id")).alias("b"))
    return best.select("name", "b.id", F.when(F.col("b.src") == 0, "label").otherwise("alias").alias("via"))


#: Frequent relations that are sent to all tasks at once; with more, each part of them is sent in turn.
SENT_RELATIONS = 200_000


def _best_match(canon, threshold: float):
    """The most similar of the shared relations to each of a column.

    Characters that both have, each as often as in the one that has it less, bound those that match. The candidates
    are scored by this bound from above, until it falls under the best score, so that few are and none is missed.
    """

    def counts(words: list[str]) -> np.ndarray:
        out = np.zeros((64, len(words)), np.int32)  # characters share a place, by which a bound is never less
        for i, w in enumerate(words):
            np.add.at(out[:, i], [ord(c) % 64 for c in w], 1)
        return out if out.max(initial=0) > 255 else out.astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        words = sorted(canon.value, key=len)
        length, have = np.array([len(w) for w in words], np.int64), counts(words)
        matcher, t = SequenceMatcher(None), max(threshold, 1e-9)
        for b in batches:
            out = []
            for w in b.column(0).to_pylist():
                n = len(w)
                # lengths alone rule most out: matching characters are at most those of the shorter one
                lo, hi = np.searchsorted(length, t * n / (2 - t) - 1e-9), np.searchsorted(length, n * (2 - t) / t + 1e-9, "right")
                own, both = counts([w])[:, 0], np.zeros(hi - lo, np.int64)
                for c in np.flatnonzero(own):
                    both += np.minimum(have[c, lo:hi], own[c])
                bound = np.where(n + length[lo:hi] > 0, 2.0 * both / np.maximum(n + length[lo:hi], 1), 1.0)
                at = np.flatnonzero(bound >= threshold)
                bound = bound[at]
                at += lo
                best = None
                matcher.set_seq1(w)
                for j in np.argsort(-bound, kind="stable"):
                    if best is not None and bound[j] < best[0]:
                        break
                    matcher.set_seq2(words[at[j]])
                    r = matcher.ratio()
                    if r >= threshold and (best is None or (r, words[at[j]].encode()) > (best[0], best[1].encode())):
                        best = r, words[at[j]]
                if best is not None:
                    out.append((w, best[1], best[0]))
            yield pa.RecordBatch.from_pydict({"relation": pa.array([x[0] for x in out], pa.string()), "canonical": pa.array([x[1] for x in out], pa.string()), "ratio": pa.array([x[2] for x in out], pa.float64())})

    return run


def canonical_relations(counts: DataFrame, frequent: int = 5, threshold: float = 0.6) -> DataFrame:
    """(relation, canonical, ratio): rare relations with the most similar frequent one, if similar enough.

    ``counts`` has relation and n, a row a distinct relation. The ratio is twice the matching characters over all, by
    recursive longest blocks. The frequent relations are sent to all tasks, ``SENT_RELATIONS`` or so at once.
    """
    counts = cut(counts.filter("relation is not null"))
    canon = counts.filter(F.col("n") >= frequent).select("relation")
    rare = counts.filter(F.col("n") < frequent).select("relation")
    parts = max(1, -(-canon.count() // SENT_RELATIONS))
    rare = rare.repartition(max(1, -(-rare.count() // RARE_ROWS)))
    found = None
    for i in range(parts):
        words = [r.relation for r in canon.filter(F.pmod(F.xxhash64("relation"), F.lit(parts)) == i).collect()]
        shared = counts.sparkSession.sparkContext.broadcast(sorted(words))
        part = rare.mapInArrow(_best_match(shared, threshold), "relation string, canonical string, ratio double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("relation").agg(F.max_by("canonical", F.struct("ratio", F.col("canonical"))).alias("canonical"), F.round(F.max("ratio"), 6).alias("ratio"))


#: Rare relations of a task.
RARE_ROWS = 2000


def parse_relations(text: str | None) -> list[tuple[str, str, str]]:
    """(subject, relation, object) of generated markup: a subject, then its objects, each with a relation."""
    out: list[tuple[str, str, str]] = []
    subject, relation, object_ = [], [], []
    into: list[str] | None = None

    def built() -> None:
        if subject and relation and object_:
            out.append((" ".join(subject), " ".join(relation), " ".join(object_)))

    for token in (text or "").replace("<s>", " ").replace("</s>", " ").replace("<pad>", " ").split():
        if token == "<triplet>":
            built()
            subject, relation, object_ = [], [], []
            into = subject
        elif token == "<subj>":
            if relation:  # it stays for an object without one of its own
                built()
                object_ = []
            into = object_
        elif token == "<obj>":
            relation = into = []
        elif into is not None:
            into.append(token)
    built()
    return out


def relations_of(texts):
    """A column of the relations in a column of generated markup."""

    @F.pandas_udf("array<struct<subject:string,relation:string,object:string>>")
    def parsed(x: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("subject", "relation", "object"), t)) for t in parse_relations(y)] for y in x])

    return parsed(texts)


def toy_relations(texts: DataFrame) -> DataFrame:
    """(main, subject, relation, object) of the first three words, in place of a model's."""
    # a word begins at its first letter or digit and ends at a space; what else is in it is left out
    w = F.lower("text")
    word = lambda i: F.regexp_replace(F.regexp_extract(w, "^" + "[^a-z0-9]*+([a-z0-9][^ ]*+)" * i, i), "[^a-z0-9]", "")
    rows = texts.select("main", word(1).alias("subject"), word(2).alias("relation"), word(3).alias("object"))
    return rows.filter("main is not null and object <> ''")


#: What a linked entity of each class gets besides the link: predicates of its label, and further types.
ENRICHMENT = {
    V.PERSON: (["foaf:name"], ["foaf:Person"]),
    V.EVENT: (["kg:eventName"], ["schema:Event"]),
    V.SITE: (["schema:alternateName"], ["schema:WebSite"]),
    V.MEME: (["schema:headline"], ["schema:CreativeWork"]),
    V.SUBCULTURE: (["foaf:name"], ["foaf:Group", "schema:Organization"]),
}


def enrich(linked: DataFrame) -> DataFrame:
    """Triples of linked entities, from rows of s, class, label and iri: the link, the name, and the class's own."""
    out = melt(linked, F.col("s"), iri(V.SAME_AS, F.col("iri")), literal("schema:name", F.col("label")))
    for cls, (names, kinds) in ENRICHMENT.items():
        out = out.unionByName(melt(linked.filter(F.col("class") == cls), F.col("s"), *(literal(p, F.col("label")) for p in names), *(iri(V.TYPE, t) for t in kinds)))
    online = linked.filter((F.col("class") == V.SUBCULTURE) & F.lower("label").rlike("reddit|chan|board|forum"))
    other = linked.filter(~F.col("class").isin(*ENRICHMENT))
    return out.unionByName(melt(online, F.col("s"), iri(V.TYPE, "schema:OnlineCommunity"))).unionByName(melt(other, F.col("s"), literal("skos:prefLabel", F.col("label")), iri(V.TYPE, "schema:Thing")))


def mark_sources(triples: DataFrame, source: str) -> DataFrame:
    """Source triples for the extracted predicates that have none."""
    marked = match(triples, p=V.EXTRACTED_BY).select("s").distinct()
    bare = marked.join(match(triples, p=V.SOURCE).select("s").distinct(), "s", "left_anti")
    return melt(bare, F.col("s"), literal(V.SOURCE, source))


def first_hundred(rows: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first rows in an order, numbered."""
    top = rows.orderBy(order).limit(n)
    return top.withColumn("i", F.row_number().over(Window.orderBy(order)))
