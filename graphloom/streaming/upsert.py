"""Idempotent incremental runs of the text upsert on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import vocab as V
from ..operators.corpus import ocr_changes
from ..schema import literal, melt

TEXTS = "filename string, text string, pos long"


def changed_triples(instances: DataFrame, current: DataFrame, batch: DataFrame) -> DataFrame:
    """New text triples of a batch: of each file the last text, where it isn't what the store has."""
    texts = batch.filter("text is not null").groupBy("filename").agg(F.max_by("text", "pos").alias("text"))
    known = instances.join(current, "s", "left").select("s", "filename", "old")
    return melt(ocr_changes(known, texts).filter("change in ('add', 'replace')"), F.col("s"), literal(V.OCR_TEXT, F.col("text")))


def upsert_stream(spark: SparkSession, source: str, instances: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of ``source`` (filename, text, pos) and appends the changed triples to ``store`` by version.

    A batch that is run again writes to its own folder again, so nothing is applied twice.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        changed_triples(instances, current_texts(spark, store, epoch), batch).select("s", F.col("o").alias("text")).write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return spark.readStream.schema(TEXTS).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_texts(spark: SparkSession, store: str, before: int = 2**62) -> DataFrame:
    """(s, old): the newest text of each instance from the versions before an epoch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "s string, text string, epoch long"
    if not fs.exists(path):
        return spark.createDataFrame([], "s string, old string")
    rows = spark.read.schema(schema).parquet(store).filter(F.col("epoch") < before)
    return rows.groupBy("s").agg(F.max_by("text", "epoch").alias("old"))
