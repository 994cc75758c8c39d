"""Readers of the source tables: entries, recognised texts, detections, labels, images, extractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import cut

ENTRY_COLUMNS = {
    "url": "URL", "id": "ID", "title": "Title", "status": "Status", "entry_category": "Entry Type", "entry_type_names": "Formats", "entry_types": "Format Details", "entry_type_ids": "Format IDs",
    "type": "Type", "badges": "Badges", "year": "Year", "origin_location": "Origin", "region": "Region", "series_name": "Series", "series_link": "Series Link", "related_entities_url": "Related",
    "recent_images": "Recent Images", "main_image_url": "Main Image", "html_file": "HTML File", "views": "Views", "video_count": "Videos", "photo_count": "Photos", "comment_count": "Comments",
    "about_text": "About", "origin_text": "Origin Text", "spread_text": "Spread", "full_text": "Full Text", "meta_description": "Description", "tags": "Tags", "external_references": "References",
}
STATUSES = ["Confirmed", "Unconfirmed", "confirmed", "unconfirmed", "Submission"]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, tolerant: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with quoted line ends, all columns as text. Tolerant reading drops malformed rows, for which it needs the columns."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, mode="DROPMALFORMED" if tolerant else "PERMISSIVE", enforceSchema=False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_entries(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Entries with their columns renamed, those of unnamed columns dropped, of the accepted statuses only."""
    rows = read_csv(spark, path, list(ENTRY_COLUMNS) if tolerant else None, tolerant)
    rows = rows.drop(*[c for c in rows.columns if c.startswith(("Unnamed: ", "_c"))])
    rows = rows.withColumnsRenamed({a: b for a, b in ENTRY_COLUMNS.items() if a in rows.columns})
    return rows.filter(F.col("Status").isin(*(("Confirmed", "Submission") if tolerant else STATUSES)))


def clean_entries(rows: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Entries with control characters, null-like texts and broken URLs put right, and names that are fit for IRIs.

    With ``urls`` (url, title) the URLs of related entries, in lists or alone, become titles.
    """
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    rows = rows.withColumns({c: X.null_out(X.strip_control(F.col(f"`{c}`"))) for c in texts})
    fixes = {c: X.repair_url(F.col(f"`{c}`")) for c in ("URL", "Series Link", "Main Image") if c in rows.columns}
    fixes |= {c: X.strip_punctuation(F.col(c)) for c in ("Title", "Series") if c in rows.columns}
    rows = rows.withColumns(fixes)
    rows = rows.withColumns({f"Safe {c}": X.uri_safe(F.col(c)) for c in ("Title", "Series") if c in rows.columns})
    if urls is not None and "Related" in rows.columns:
        rows = replace_urls(rows, "Related", urls)
    return rows


def url_index(rows: DataFrame) -> DataFrame:
    """(url, title) with the last title of each URL, from the first column there is that holds URLs."""
    url = next(c for c in ("Entry URL", "URL", "Link", "url") if c in rows.columns)
    title = next(c for c in ("Title", "title") if c in rows.columns)
    return rows.withColumn("_pos", F.monotonically_increasing_id()).filter(F.col(url).isNotNull()).groupBy(X.repair_url(F.col(url)).alias("url")).agg(F.max_by(title, "_pos").alias("title"))


def replace_urls(rows: DataFrame, column: str, urls: DataFrame) -> DataFrame:
    """A printed list, or a single text, of URLs as an array of titles in the same order; unknown URLs stay."""
    items = X.repair_urls(F.coalesce(X.parse_list(F.col(column)), F.when(F.col(column).isNotNull(), F.array(column))))
    keyed = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # both sides of the join need the same numbers
    parts = keyed.select("_row", F.posexplode(items).alias("_pos", "url")).join(urls, "url", "left")
    lists = parts.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("title", "url").alias("t")))), lambda x: x["t"]).alias("_list"))
    return keyed.join(lists, "_row", "left").withColumn(column, F.col("_list")).drop("_row", "_list")


def combine(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name, the first of each ID and title."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_file", F.lit(i)) for i, f in enumerate(frames)])
    from ..operators.corpus import first_of

    return first_of(rows.withColumn("_pos", F.monotonically_increasing_id()), ["ID", "Title"], ["_file", "_pos"]).drop("_file", "_pos")


def write_entries(rows: DataFrame, path: str) -> None:
    """CSV with all fields quoted and nulls as empty ones."""
    rows.write.csv(path, header=True, quoteAll=True, escape="\\", nullValue="", emptyValue="")


def sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows that a digest of their key chooses, the same on every run."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def structure_check(spark: SparkSession, path: str) -> DataFrame:
    """(lines, header_fields, min_fields, max_fields, odd_quotes) of a CSV's lines, by counting commas outside quotes."""
    lines = spark.read.text(path).filter("value <> ''")
    header = F.size(F.split(F.lit(lines.first().value if lines.limit(1).count() else ""), ","))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.agg(F.count("*").alias("lines"), F.max(header).alias("header_fields"), F.min(fields).alias("min_fields"), F.max(fields).alias("max_fields"), F.count_if(quotes % 2 == 1).alias("odd_quotes"))


def status_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, name, n): rows of each status, null among them, and the values of some columns that aren't null."""
    by = rows.groupBy("Status").agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), F.coalesce("Status", F.lit("null")).alias("name"), "n")
    filled = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).unpivot([], columns, "name", "n")
    return by.unionByName(filled.select(F.lit("filled").alias("kind"), "name", "n"))


TEXT_COLUMNS = ["ocr", "OCR", "text", "Text", "ocr_text", "caption"]
FILE_COLUMNS = ["Image Ref", "file", "filename", "image"]


def _undecodable(spark: SparkSession, path: str) -> bool:
    """Whether some line isn't UTF-8."""
    return not spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def read_ocr(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(filename, text, class_id, n_chars, n_words, pos) of recognised texts; blanks, null words and single characters are left out.

    A file that isn't UTF-8 is read as Latin-1. The text column is the first of the usual names, else the one of the longest mean text. The class is the
    label, else what stands before the first dash of the file's name.
    """
    rows = read_csv(spark, path, encoding=encoding)
    if encoding == "UTF-8" and _undecodable(spark, path):
        rows = read_csv(spark, path, encoding="ISO-8859-1")
    text = next((c for c in TEXT_COLUMNS if c in rows.columns), None)
    if text is None:
        means = rows.agg(*(F.avg(F.length(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(rows.columns))).first()
        text = rows.columns[max(range(len(rows.columns)), key=lambda i: means[i] or 0)]
    file = next((c for c in FILE_COLUMNS if c in rows.columns), rows.columns[0])
    label = next((F.col(c) for c in ("label", "Label") if c in rows.columns), F.lit(None).cast("string"))
    name = X.basename(F.col(f"`{file}`"))
    t = F.trim(F.col(f"`{text}`"))
    out = rows.select(name.alias("filename"), t.alias("text"), F.coalesce(label, F.when(name.contains("-"), F.substring_index(name, "-", 1)), F.lit("unknown")).alias("class_id"))
    out = out.filter(F.col("text").isNotNull() & ~F.lower("text").isin("nan", "null", "none", "") & (F.length("text") >= 2))
    return out.withColumns({"n_chars": F.length("text"), "n_words": F.size(X.words(F.col("text"))), "pos": F.monotonically_increasing_id()})


def read_images(spark: SparkSession, root: str, dataset_type: str, suffixes: str = "{jpg,jpeg,png,gif,webp,bmp}") -> DataFrame:
    """(path, filename, class_id, dataset_type) of image files at any depth, the class being the folder; contents aren't read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=f"*.{suffixes}").load(root)
    return files.select("path", X.basename(F.col("path")).alias("filename"), F.element_at(F.split("path", "/"), -2).alias("class_id"), F.lit(dataset_type).alias("dataset_type"))


_WEB = {
    "web_entities": "array<struct<entity_id:string,description:string,score:double>>", "best_guess_labels": "array<struct<label:string,language_code:string>>",
    "full_matching_images": "array<string>", "visually_similar_images": "array<string>", "pages_with_matching_images": "array<string>",
}


def read_web_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections with their printed lists as arrays; a list that can't be read is null."""
    rows = read_csv(spark, path)
    as_json = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("None"), F.lit("null")), r"(?<=[\[{,:\s])'|'(?=\s*[\]},:])", '"'), r"\\'", "'")
    missing = {c: F.lit(None).cast("string") for c in ("error", "timestamp", *_WEB) if c not in rows.columns}
    return rows.withColumns(missing).withColumns({c: F.from_json(as_json(F.col(c)), kind) for c, kind in _WEB.items()})


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(main, subject, relation, object) of an extraction file: a map from file names to lists of three."""
    rows = spark.read.schema("total_texts long, texts_with_relations long, extractions map<string,array<array<string>>>").json(path, multiLine=True)
    return rows.select(F.explode("extractions").alias("main", "r")).select("main", F.explode("r").alias("r")).select("main", *(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(("subject", "relation", "object"))))


_LABELS = "id string, labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>"
LANGUAGES = ["en", "en-gb", "en-us"]


def read_label_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, src): the English labels (0) and aliases (1) of items of a dump of one JSON object a line.

    A gzip file is read by one task; it should be split before.
    """
    lines = spark.read.text(path).select(F.rtrim(F.rtrim("value"), F.lit(",")).alias("j")).filter(F.col("j").startswith("{"))
    items = lines.select(F.from_json("j", _LABELS).alias("x")).select("x.*").filter(F.col("id").rlike("^Q[0-9]+$"))
    label = items.select("id", F.explode("labels").alias("lang", "v")).select("id", "lang", F.col("v.value").alias("label"), F.lit(0).alias("src"))
    alias = items.select("id", F.explode("aliases").alias("lang", "vs")).select("id", "lang", F.explode("vs.value").alias("label"), F.lit(1).alias("src"))
    both = label.unionByName(alias).filter(F.col("lang").isin(*LANGUAGES)).withColumn("label", X.normalize_label(F.col("label")))
    return both.filter(F.length("label") > 1).groupBy("label", "src").agg(F.max("id").alias("id")).select("id", "label", "src")


def label_stats(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count_if(F.col("src") == 0).alias("labels"), F.count_if(F.col("src") == 1).alias("aliases"), F.count_distinct("id").alias("entities"))


def write_labels(dictionary: DataFrame, path: str) -> None:
    """Keeps a label dictionary, sorted by label, so that a look-up of few labels reads few row groups."""
    dictionary.select("id", "label", "src").repartitionByRange("label").sortWithinPartitions("label").write.parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary that ``write_labels`` kept."""
    return spark.read.schema("id string, label string, src int").parquet(path)


def write_vectors(vectors: DataFrame, path: str, cls: str = "class_id") -> None:
    """Vectors with their metadata in one table, and the popularity of their classes in another."""
    from ..operators.corpus import popularity_rank

    vectors.write.parquet(f"{path}/vectors")
    popularity_rank(vectors, cls).coalesce(1).write.json(f"{path}/popularity")


def write_json(df: DataFrame, path: str) -> None:
    """A report as one JSON object a row."""
    df.write.json(path)


def split_list(c: Column, separator: str) -> Column:
    """The parts of a delimited text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, separator), F.trim), lambda x: x != "")
