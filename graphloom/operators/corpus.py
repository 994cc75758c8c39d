"""Instances of both modalities: joining them, turning them into triples, upserting their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..schema import COLUMNS, iri, literal, melt
from ..session import cut


def _side(rows: DataFrame, index: str) -> DataFrame:
    """One row a file: the index of the last duplicate, everything else of the first."""
    rest = [c for c in rows.columns if c not in ("filename", "idx")]
    kept = rows.filter("filename is not null and class_id is not null")
    return kept.groupBy("filename").agg(F.max("idx").alias(index), *(F.min_by(c, "idx").alias(c) for c in rest))


def unified_instances(vision: DataFrame, text: DataFrame) -> DataFrame:
    """The full outer join of image and text rows on the file name.

    Class, dataset and entry come from the image side where both have them. ``modality`` tells the sides.
    """
    v, t = _side(vision, "vision_idx"), _side(text, "text_idx")
    shared = ["class_id", "dataset_type", "entry_id"]
    joined = v.select("filename", "vision_idx", *(F.col(c).alias(f"v_{c}") for c in shared)).join(t, "filename", "full_outer")
    modality = F.when(F.col("text_idx").isNull(), "vision").when(F.col("vision_idx").isNull(), "text").otherwise("both")
    return joined.select("filename", *(F.coalesce(f"v_{c}", c).alias(c) for c in shared), "vision_idx", "text_idx", "text", modality.alias("modality"))


def instance_triples(rows: DataFrame, s) -> DataFrame:
    """Triples of unified rows that have an ``entry``; each triple once, as file names are unique."""
    return melt(
        rows, s, iri(V.TYPE, V.INSTANCE), iri(V.BELONGS_TO, F.col("entry")), literal(V.LABEL, F.col("filename")), literal(V.MODALITY, F.col("modality")),
        literal(V.DATASET_TYPE, F.col("dataset_type")), literal(V.VISION_INDEX, F.col("vision_idx"), V.INTEGER), literal(V.TEXT_INDEX, F.col("text_idx"), V.INTEGER), literal(V.OCR_TEXT, F.col("text")),
    )


def bridge_mapping(rows: DataFrame) -> DataFrame:
    """(modality, idx, instance): which instance each index position of either side stands for, from unified rows."""
    s = F.concat(F.lit("instance/"), F.col("filename"))
    side = lambda m: rows.filter(F.col(f"{m}_idx").isNotNull()).select(F.lit(m).alias("modality"), F.col(f"{m}_idx").alias("idx"), s.alias("instance"))
    return side("vision").unionByName(side("text"))


def build_summary(rows: DataFrame) -> DataFrame:
    """Instances of unified rows, by modality and dataset, and those with an entry, in one pass."""
    n = lambda c, name: F.count_if(c).alias(name)
    m = F.col("modality")
    return rows.agg(F.count("*").alias("instances"), n(m == "vision", "vision_only"), n(m == "text", "text_only"), n(m == "both", "both_sides"), n(F.col("dataset_type") == "confirmed", "confirmed"), n(F.col("entry_id").isNotNull(), "with_entry"))


def text_by_file(rows: DataFrame) -> DataFrame:
    """The last text of each file name, from rows of ``filename``, ``text`` and their position ``pos``."""
    return rows.filter("text is not null").groupBy("filename").agg(F.max_by("text", "pos").alias("text"))


def ocr_changes(instances: DataFrame, texts: DataFrame) -> DataFrame:
    """What an upsert of ``texts`` does to each instance: ``add``, ``replace``, ``unchanged`` or ``not_found``.

    ``instances`` has ``s``, ``filename`` and ``old``, its present text or null.
    """
    joined = instances.join(texts, "filename", "left")
    change = F.when(F.col("text").isNull(), "not_found").when(F.col("old").isNull(), "add").when(F.col("old") != F.col("text"), "replace").otherwise("unchanged")
    return joined.select("s", "filename", "old", "text", change.alias("change"))


def ocr_upsert(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """``triples`` after the changes; a second run of the same changes alters nothing."""
    new = changes.filter("change in ('add', 'replace')").select("s", "text")
    gone = new.select("s", F.lit(V.OCR_TEXT).alias("p"))
    return triples.join(gone, ["s", "p"], "left_anti").select(*COLUMNS).unionByName(melt(new, F.col("s"), literal(V.OCR_TEXT, F.col("text"))))


def without_extractions(instances: DataFrame, triples: DataFrame) -> DataFrame:
    """Instances that have no edge of a predicate that is marked as extracted."""
    marked = triples.filter(F.col("p") == V.EXTRACTED_BY).select(F.col("s").alias("p")).distinct()
    return instances.join(triples.join(marked, "p", "left_semi").select("s").distinct(), "s", "left_anti")


def web_triples(instances: DataFrame, detections: DataFrame) -> DataFrame:
    """Triples of web detections: entities with description and score, guesses and counts of matches.

    Detections with an ``error`` are left out. The node of a web entity is a digest of its id or description.
    """
    found = instances.join(detections.filter("error is null or error = ''"), "filename")
    node = F.concat(F.lit("web/"), F.substring(F.md5(F.coalesce(F.col("e.entity_id"), F.col("e.description"))), 1, 12))
    entities = found.select("s", F.explode("web_entities").alias("e")).filter("e.description is not null").withColumn("n", node)
    guesses = found.select("s", F.explode("best_guess_labels").alias("g"))
    return (
        melt(entities, F.col("s"), iri("kg:hasWebEntity", F.col("n")), unique=False)
        .unionByName(melt(entities, F.col("n"), iri(V.TYPE, "kg:WebEntity"), literal(V.LABEL, F.col("e.description")), literal("kg:confidence", F.col("e.score"), "xsd:float"), unique=False))
        .unionByName(melt(guesses, F.col("s"), literal("kg:bestGuess", F.col("g.label")), unique=False))
        .unionByName(melt(found, F.col("s"), literal("kg:fullMatches", F.size("full_matching_images"), V.INTEGER), literal("kg:similarImages", F.size("visually_similar_images"), V.INTEGER), literal("kg:pages", F.size("pages_with_matching_images"), V.INTEGER), literal("kg:detectedAt", F.col("timestamp"), "xsd:dateTime")))
    )


def popularity_rank(rows: DataFrame, cls: str = "class_id", pos: str = "idx") -> DataFrame:
    """Classes by their number of rows, ranked from 0; of equal ones the first seen comes first.

    The window is over one row a class.
    """
    per = rows.groupBy(cls).agg(F.count("*").alias("popularity"), F.min(pos).alias("first_pos"))
    return per.select(cls, "popularity", (F.row_number().over(Window.orderBy(F.desc("popularity"), "first_pos")) - 1).cast("long").alias("popularity_rank"))


def stratified_split(rows: DataFrame, by: list[str], key: str, train: float = 0.8) -> DataFrame:
    """``rows`` with ``split``: of each group max(1, floor(train * n)) for training, by a digest of ``key``; a group of one is for training.

    The digest's first digits cut each group into ranges that are counted; only the range with a group's last
    row for training is ranked, so that no task sorts a group, however few groups there are.
    """
    digest, slot = F.md5(F.col(key).cast("string")), F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int")
    keyed = rows.withColumn("_slot", slot)
    per = keyed.groupBy(*by, "_slot").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    per = per.withColumn("_n", F.sum("_c").over(group)).withColumn("_before", F.sum("_c").over(group.orderBy("_slot")) - F.col("_c"))
    most = F.when(F.col("_n") == 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(float(train)) * F.col("_n"))))
    last = per.withColumn("_most", most).filter("_before < _most and _most <= _before + _c").select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_slot").alias("_last"), (F.col("_most") - F.col("_before")).alias("_left"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    placed = keyed.join(last, reduce(lambda a, b: a & b, same)).drop(*(f"_by_{i}" for i in range(len(by))))
    clear = placed.filter("_slot <> _last").withColumn("split", F.when(F.col("_slot") < F.col("_last"), "train").otherwise("test"))
    order = Window.partitionBy(*by, "_slot").orderBy(digest, key)
    ranked = placed.filter("_slot = _last").withColumn("split", F.when(F.row_number().over(order) <= F.col("_left"), "train").otherwise("test"))
    return clear.unionByName(ranked).select(*rows.columns, "split")


def index_cube(rows: DataFrame) -> DataFrame:
    """Rows and classes of every subset that an index is made of: dataset and split, each or all."""
    return rows.cube("dataset_type", "split").agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("classes")).select(F.coalesce("dataset_type", F.lit("all")).alias("dataset_type"), F.coalesce("split", F.lit("all")).alias("split"), "n", "classes")


def index_summary(cube: DataFrame) -> DataFrame:
    """(subset, n, classes, rank): the subsets of ``index_cube`` by their size."""
    w = Window.orderBy(F.desc("n"), "dataset_type", "split")  # over nine rows at most
    return cube.select(F.concat_ws("/", "dataset_type", "split").alias("subset"), "n", "classes", F.row_number().over(w).cast("long").alias("rank"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate, which tasks make for their own rows before any shuffle."""
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in rows.columns))
    first = rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def dense_subset(rows: DataFrame, condition, order: str) -> DataFrame:
    """The rows of a subset with ``position`` from 0 in the order of a unique column.

    Positions come from counts of ranges, so that no task sorts all rows.
    """
    ranged = rows.filter(condition).repartitionByRange(order).sortWithinPartitions(order)
    numbered = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))  # ranges are sampled, so they are drawn once
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return numbered.withColumn("_p", part).join(before, "_p").withColumn("position", F.col("_b") + place).drop("_m", "_p", "_b")
