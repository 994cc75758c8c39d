"""Triple patterns and the small algebra of graph queries over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import local_name
from ..session import BROADCAST_ROWS, cut, spread


def match(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples that agree with the bound terms; a list binds any of its terms."""
    out = triples
    for name, term in (("s", s), ("p", p), ("o", o)):
        if isinstance(term, (list, tuple, set)):
            out = out.filter(F.col(name).isin(*term))
        elif term is not None:
            out = out.filter(F.col(name) == term)
    return out


def subjects(triples: DataFrame, p=None, o=None) -> DataFrame:
    return match(triples, p=p, o=o).select("s").distinct()


def objects(triples: DataFrame, s=None, p=None) -> DataFrame:
    return match(triples, s=s, p=p).select("o").distinct()


def predicates(triples: DataFrame, s=None, o=None) -> DataFrame:
    return match(triples, s=s, o=o).select("p").distinct()


def types(triples: DataFrame) -> DataFrame:
    return match(triples, p=V.TYPE).select("s", F.col("o").alias("t"))


def labels(triples: DataFrame) -> DataFrame:
    """One label a node, the least."""
    return match(triples, p=V.LABEL).groupBy("s").agg(F.min("o").alias("label"))


def having(rows: DataFrame, triples: DataFrame, p: str, o=None, negate: bool = False) -> DataFrame:
    """Rows whose ``s`` has a triple of the pattern, or has none."""
    return rows.join(spread(match(triples, p=p, o=o).select("s"), "s"), "s", "left_anti" if negate else "left_semi")


def in_namespace(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def is_variable(term: str) -> bool:
    return term.startswith("?")


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Solutions of a basic graph pattern: a column for each variable, a row for each match.

    Terms beginning with ``?`` are variables. Patterns are joined on the variables that they share with those
    before them; Catalyst orders the joins and turns constants into pushed filters.
    """
    out = None
    for s, p, o in patterns:
        part = match(triples, *(None if is_variable(x) else x for x in (s, p, o)))
        seen: dict[str, str] = {}
        for column, term in zip("spo", (s, p, o)):
            if is_variable(term):
                if term in seen:
                    part = part.filter(F.col(seen[term]) == F.col(column))
                else:
                    seen[term] = column
        part = part.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))
        if out is None:
            out = part
        else:
            shared = [c for c in part.columns if c in out.columns]
            out = out.join(part, shared) if shared else out.crossJoin(part)
    return out


def optional(rows: DataFrame, solutions: DataFrame) -> DataFrame:
    """Rows with the solutions they have in common variables, and nulls where they have none."""
    return rows.join(solutions, [c for c in solutions.columns if c in rows.columns], "left")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def star(triples: DataFrame, wanted: dict[str, str], subjects: DataFrame | None = None) -> DataFrame:
    """One row a subject with the least object of each wanted predicate, by column name: one shuffle, no join."""
    rows = match(triples, p=list(wanted.values()))
    if subjects is not None:
        rows = rows.join(subjects.select("s").distinct(), "s", "left_semi")
    return rows.groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in wanted.items()))


def first_label(rows: DataFrame, triples: DataFrame, node: str = "s", name: str = "label") -> DataFrame:
    """Rows with the label of their node, or the tail of its name."""
    known = labels(triples).select(F.col("s").alias(node), F.col("label").alias("_label"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("_label", local_name(F.col(node)))).drop("_label")


def find_label(triples: DataFrame, text: str, limit: int = 1) -> DataFrame:
    """Entries whose label has ``text`` in it, in any case, by label."""
    hits = match(triples, p=V.LABEL).filter(F.lower("o").contains(text.lower()))
    return having(hits, triples, V.TYPE, V.ENTRIES).select("s", F.col("o").alias("label")).orderBy("label", "s").limit(limit)


def exact_label(triples: DataFrame, label: str, limit: int = 1) -> DataFrame:
    """(s, label, type): the entry of exactly this label, the first by name and class."""
    hits = match(triples, p=V.LABEL, o=label).select("s", F.col("o").alias("label"))
    kinds = types(triples).filter(F.col("t").isin(*V.ENTRIES)).select("s", F.col("t").alias("type"))
    return hits.join(kinds, "s").orderBy("s", "type").limit(limit)


def sample_entities(triples: DataFrame, cls: str | None = None, limit: int = 20) -> DataFrame:
    """(s, label): the first entities by label, of a class if one is named."""
    known = labels(triples)
    if cls is not None:
        known = known.join(subjects(triples, V.TYPE, cls), "s", "left_semi")
    return known.select("s", "label").orderBy("label", "s").limit(limit)


def connection_totals(others: DataFrame, memes: DataFrame) -> DataFrame:
    """(e, n, memes, types, kinds, engagement): what ``secondary_connections`` say of each entity, with the engagement of its memes."""
    rows = others.join(memes.select("meme", "engagement"), "meme")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("e").agg(F.count("*").alias("n"), F.count_distinct("meme").alias("memes"), names("type").alias("types"), names("kind").alias("kinds"), F.sum("engagement").alias("engagement"))


def connections(triples: DataFrame) -> DataFrame:
    """(meme, kind, e): the edges by which memes are connected, kind being the predicate's local name."""
    memes = match(triples, p=V.TYPE, o=V.MEME).select("s")
    return match(triples, p=list(V.CONNECTIONS)).join(memes, "s", "left_semi").select(F.col("s").alias("meme"), "p", local_name(F.col("p")).alias("kind"), F.col("o").alias("e"))


def entity_connections(triples: DataFrame, entity: str) -> DataFrame:
    """Memes that mention, carry as tag or are in the series of ``entity``: by their strongest connection, with year and counts."""
    rows = connections(match(triples)).filter(F.col("e") == entity)
    weight = F.create_map(*(x for p, w in V.CONNECTIONS.items() for x in (F.lit(p), F.lit(w))))[F.col("p")]
    best = rows.groupBy("meme").agg(F.max_by("kind", weight).alias("kind"), F.count("*").alias("n_kinds"))
    facts = star(triples, {"views": V.VIEWS, "comments": V.COMMENTS, "label": V.LABEL}, best.select(F.col("meme").alias("s")))
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    return best.join(facts.withColumnRenamed("s", "meme"), "meme", "left").select("meme", "label", "kind", "n_kinds", (number("views") + 10 * number("comments")).alias("engagement"))


def secondary_connections(triples: DataFrame, memes: DataFrame) -> DataFrame:
    """(meme, kind, e, type): entries of other classes that the memes connect to, for all memes in one join."""
    rows = connections(triples).join(memes.select("meme").distinct(), "meme", "left_semi")
    wanted = types(triples).filter(F.col("t").isin(*[t for t in V.ENTRIES if t != V.MEME]))
    not_meme = cut(rows.join(match(triples, p=V.TYPE, o=V.MEME).select(F.col("s").alias("e")), "e", "left_anti"))  # a few memes' connections, against all types
    wanted = wanted.join(F.broadcast(not_meme.select(F.col("e").alias("s")).distinct()), "s", "left_semi") if not_meme.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    return not_meme.join(wanted.withColumnRenamed("s", "e"), "e").select("meme", "kind", "e", F.col("t").alias("type"))


def connection_counts(triples: DataFrame) -> DataFrame:
    """Of each entity, the memes that are connected to it in each way, in one pass."""
    rows = connections(triples)
    return rows.groupBy("e").agg(*(F.count_distinct(F.when(F.col("p") == p, F.col("meme"))).alias(c) for c, p in (("n_mentions", V.MENTIONS), ("n_tags", V.HAS_TAG), ("n_series", V.PART_OF_SERIES))))


def cooccurrence(pairs: DataFrame, top: int = 10) -> DataFrame:
    """(e1, e2, shared): memes that two of the ``top`` entities share; ``pairs`` has meme and e."""
    pairs = pairs.select("meme", "e").distinct()
    best = pairs.groupBy("e").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "e").limit(top).select("e")
    kept = pairs.join(best, "e", "left_semi")
    other = kept.select("meme", F.col("e").alias("e2"))
    return kept.withColumnRenamed("e", "e1").join(other, "meme").filter("e1 <> e2").groupBy("e1", "e2").agg(F.count("*").alias("shared"))


def top_within(rows: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= n)
