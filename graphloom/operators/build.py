"""Triples of cleaned entries and of the metadata in their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..schema import as_set, iri, literal, melt
from ..sources.tables import split_list
from .linking import registry_types

_COUNTS = {"Views": V.VIEWS, "Videos": "kg:videoCount", "Photos": "kg:photoCount", "Comments": V.COMMENTS}
_TEXTS = {"URL": "kg:url", "Main Image": "kg:mainImage", "Region": "kg:region", "Description": "kg:description", "Origin": "kg:origin"}


def entry_triples(rows: DataFrame) -> DataFrame:
    """Triples of entries: class, id, label, counts, texts and year; columns that a table lacks are passed over."""
    s = F.concat(F.lit("entry/"), X.slug(F.col("Title")))
    has = lambda c: c in rows.columns
    terms = [iri(V.TYPE, X.entry_class(F.col("Entry Type") if has("Entry Type") else F.lit("meme"))), literal(V.LABEL, F.col("Title")), literal(V.ID, F.col("ID"))]
    terms += [literal(p, F.col(c).try_cast("long"), V.INTEGER) for c, p in _COUNTS.items() if has(c)]
    terms += [literal(p, F.col(f"`{c}`")) for c, p in _TEXTS.items() if has(c)]
    if has("Year"):
        terms.append(literal(V.YEAR, X.year(F.col("Year")), V.GYEAR))
    return melt(rows.filter("Title is not null"), s, *terms, unique=False)


def _cells(rows: DataFrame) -> DataFrame:
    """(title, r, seq, kind, p, type, name): the values of cells that name other nodes, in the order of the columns."""
    tags = F.when(F.col("Tags").contains("|"), split_list(F.col("Tags"), "\\|")).otherwise(F.coalesce(X.parse_list(F.col("Tags")), F.array(F.trim("Tags"))))
    plan = [
        ("Status", "status", V.HAS_STATUS, V.STATUS, F.array("Status")), ("Badges", "badge", V.HAS_BADGE, V.BADGE, split_list(F.col("Badges"), ",")), ("Formats", "format", V.HAS_MEME_TYPE, V.MEME_TYPE, split_list(F.col("Formats"), "\\|")),
        ("Tags", "tag", V.HAS_TAG, V.TAG, tags), ("Series", "series", V.PART_OF_SERIES, V.SERIES, F.array("Series")),
    ]
    out = None
    for seq, (column, kind, p, t, names) in enumerate(plan, 1):
        if column not in rows.columns:
            continue
        part = rows.filter(F.col(column).isNotNull()).select(F.col("Title").alias("title"), "r", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(p).alias("p"), F.lit(t).alias("type"), F.posexplode(names).alias("pos", "name")).filter("name is not null and name <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def build_graph(entries: DataFrame) -> DataFrame:
    """The triples of entries with a row number ``r``: their own, their edges, and nodes typed by the registry's rule.

    Entries and the values of their cells share one registry by slug, so that a tag that is named before an
    entry of the same name gives it a second type.
    """
    rows = entries.filter("Title is not null")
    cells = _cells(rows).withColumn("slug", X.slug(F.col("name")))
    asserted = rows.select(X.slug(F.col("Title")).alias("slug"), X.entry_class(F.col("Entry Type")).alias("type"), F.lit(True).alias("is_entry"), "r", F.lit(0).alias("seq")).unionByName(
        cells.select("slug", "type", F.lit(False).alias("is_entry"), "r", (F.col("seq") * 1000 + F.col("pos")).cast("int").alias("seq"))
    )
    node = lambda c: F.concat(F.lit("entry/"), c)
    types = melt(registry_types(asserted), node(F.col("slug")), iri(V.TYPE, F.col("type")))
    first = cells.groupBy("slug").agg(F.min_by("name", F.struct("r", "seq", "pos")).alias("label")).join(rows.select(X.slug(F.col("Title")).alias("slug")).distinct(), "slug", "left_anti")
    edges = cells.select(node(X.slug(F.col("title"))).alias("s"), "p", node(F.col("slug")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).distinct()
    own = entry_triples(rows).filter(F.col("p") != V.TYPE)
    return as_set(own.unionByName(types).unionByName(melt(first, node(F.col("slug")), literal(V.LABEL, F.col("label")))).unionByName(edges))


def corrected(triples: DataFrame) -> DataFrame:
    """``triples`` with the classes that labels speak against replaced."""
    label = triples.filter(F.col("p") == V.LABEL).groupBy("s").agg(F.min("o").alias("_label"))
    new = F.when(F.col("p") == V.TYPE, F.coalesce(X.corrected_class(F.col("o"), F.col("_label")), F.col("o"))).otherwise(F.col("o"))
    return as_set(triples.join(label, "s", "left").withColumn("o", new))
