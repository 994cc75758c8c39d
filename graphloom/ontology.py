"""The vocabulary as triples: classes and their order, predicates with their domains and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V

ENTRY, METADATA = "kg:Entry", "kg:Metadata"
CLASS, OBJECT, DATATYPE = "rdfs:Class", "owl:ObjectProperty", "owl:DatatypeProperty"

#: Each class with the one above it.
CLASSES = {ENTRY: None, METADATA: None, V.ENTITY: None, V.INSTANCE: V.MEME} | {t: ENTRY for t in V.ENTRIES} | {t: METADATA for t in (V.MEME_TYPE, V.TAG, V.STATUS, V.BADGE, V.SERIES)}
#: Predicates between nodes, with their domain and range.
RELATIONS = {
    "kg:documents": (ENTRY, V.ENTITY), V.HAS_STATUS: (ENTRY, V.STATUS), V.HAS_BADGE: (ENTRY, V.BADGE), V.HAS_TAG: (ENTRY, V.TAG), V.HAS_MEME_TYPE: (V.MEME, V.MEME_TYPE),
    V.PART_OF_SERIES: (ENTRY, V.SERIES), V.MENTIONS: (ENTRY, V.ENTITY), V.BELONGS_TO: (V.INSTANCE, ENTRY),
}
#: Predicates of values, with their domain and datatype.
VALUES = {
    **{p: (ENTRY, V.INTEGER) for p in (V.VIEWS, "kg:videoCount", "kg:photoCount", V.COMMENTS)}, **{p: (ENTRY, V.STRING) for p in (V.ID, "kg:url", "kg:mainImage", "kg:region", "kg:description", "kg:origin", V.TEMPORAL)},
    V.YEAR: (ENTRY, V.GYEAR), V.DATE_CREATED: (ENTRY, "xsd:date"), V.BIRTH: (V.PERSON, "xsd:date"),
    **{p: (V.INSTANCE, V.INTEGER) for p in (V.VISION_INDEX, V.TEXT_INDEX, "kg:fullMatches", "kg:similarImages", "kg:pages")}, **{p: (V.INSTANCE, V.STRING) for p in (V.MODALITY, V.DATASET_TYPE, V.OCR_TEXT, "kg:bestGuess")},
    "kg:detectedAt": (V.INSTANCE, "xsd:dateTime"), "kg:confidence": ("kg:WebEntity", "xsd:float"),
}

TERMS = (
    [(c, V.TYPE, CLASS) for c in CLASSES]
    + [(c, V.SUBCLASS, above) for c, above in CLASSES.items() if above]
    + [(p, V.TYPE, kind) for table, kind in ((RELATIONS, OBJECT), (VALUES, DATATYPE)) for p in table]
    + [(p, side, term) for table in (RELATIONS, VALUES) for p, pair in table.items() for side, term in zip((V.DOMAIN, V.RANGE), pair)]
)


def vocabulary(spark: SparkSession) -> DataFrame:
    """All terms as triples between nodes."""
    none = F.lit(None).cast("string")
    return spark.createDataFrame(TERMS, "s string, p string, o string").select("*", F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
