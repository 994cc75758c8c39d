"""Quality classifier by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SOME_TEXT, cut, free_name, join_checked, own
from .textbuf import CLASSES, blocks, mix, row_sums, tokens

BUCKETS = 1 << 16
#: Weight of the raw model in the target model, in n-grams of the raw model for each of the target's.
PRIOR = 4.0
SEED = 17
#: At most about so many labelled rows fit the model; they are chosen by a hash of doc_id.
LABELLED_ROWS = 200_000
#: A key is rounded to this many to one before the k-th is sought.
_SCALE = 1 << 20


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and punctuation runs, and of the pairs of neighbours, with their row starts."""
    h, row, starts = tokens(raw, offsets, CLASSES)
    one = (h % np.uint64(buckets)).astype(np.int64)
    if len(h) < 2:
        return one, starts, np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    same = row[1:] == row[:-1]
    two = (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same] % np.uint64(buckets)).astype(np.int64)
    pairs = np.maximum(np.diff(starts) - 1, 0)
    return one, starts, two, np.concatenate(([0], np.cumsum(pairs)))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            group = np.asarray(b.column(0)).astype(np.int64)
            for first, raw, offsets in blocks(b.column(1)):
                one, s1, two, s2 = features(raw, offsets, buckets)
                own = group[first : first + len(offsets) - 1]
                for x, s in ((one, s1), (two, s2)):
                    total += np.bincount(x + buckets * np.repeat(own, np.diff(s)), minlength=2 * buckets).reshape(2, -1)
        for g in range(2):
            at = np.flatnonzero(total[g])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[g, at])], ["g", "bucket", "n"])

    return run


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(2, buckets) counts of the hashed n-grams of ``text`` where ``g`` is 0 and 1; a row a bucket and task is shuffled."""
    counts = np.zeros((2, buckets))
    rows = texts.select("g", "text").mapInArrow(_count(buckets), "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(rows.column("g")), np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return counts


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Per bucket, the log of the target model's probability over the raw model's, the raw one being the target's prior."""
    q = (raw + 1) / (raw.sum() + len(raw))
    weight = prior * max(target.sum(), 1.0)
    return np.log((target + weight * q) / (target.sum() + weight)) - np.log(q)


def mean_log_ratio(ratio: np.ndarray):
    """A UDF: the mean log ratio of a text's n-grams; 0 for a text without any."""
    buckets = len(ratio)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for first, raw, offsets in blocks(texts):
            one, s1, two, s2 = features(raw, offsets, buckets)
            n = np.maximum(np.diff(s1) + np.diff(s2), 1)
            out[first : first + len(offsets) - 1] = (row_sums(ratio[one], s1) + row_sums(ratio[two], s2)) / n
        return pa.array(out)

    return score


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(a, b) of P(y) = 1 / (1 + exp(-a - b x)), by Newton's method with a small ridge on b."""
    a = b = 0.0
    scale = float(x.std()) or 1.0
    z = x / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum(), ((y - p) * z).sum() - ridge * b])
        h = np.array([[w.sum() + 1e-9, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + ridge]])
        da, db = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b / scale)


@dataclass
class Model:
    """Log ratios of the buckets, and how a text's mean of them gives its probability of being good."""

    ratio: np.ndarray
    a: float
    b: float

    def probability(self, text) -> F.Column:
        return F.lit(1.0) / (1.0 + F.exp(-(F.lit(self.a) + F.lit(self.b) * mean_log_ratio(self.ratio)(text))))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS) -> Model | None:
    """The model, or None unless there are texts of both labels.

    Above ``labelled_rows`` labels a hash of ``doc_id`` chooses about so many. Half of these, by the hash,
    give the target model the n-grams of their good texts; on the other half the mean log ratio is
    calibrated. The raw model counts the n-grams of all texts of ``docs``. A ``doc_id`` labelled more than
    once is good only if all its labels are 1 or more.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg((F.min("quality") >= 1).cast("int").alias("good"))
    h = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    known = cut(known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int")))
    n = known.count()
    chosen = known.filter(h < int(labelled_rows / n * (1 << 30))) if n > labelled_rows else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    target = chosen.filter("half = 0 and good = 1").select("doc_id", F.lit(1).alias("g"))
    counts = ngram_counts(join_checked(texts, target, "doc_id", "left").select(F.coalesce("g", F.lit(0)).alias("g"), "text"), buckets)
    ratio = log_ratio(counts[1], counts.sum(axis=0))
    held = join_checked(texts, chosen.filter("half = 1").select("doc_id", "good"), "doc_id", "inner").select("good", mean_log_ratio(ratio)(F.col("text")).alias("x")).toArrow()
    good, x = np.asarray(held.column("good")), np.asarray(held.column("x"))
    if not counts[1].sum() or good.min(initial=1) == good.max(initial=0):
        return None
    return Model(ratio, *logistic(x, good))


def kth_largest(values: DataFrame, k: int) -> int:
    """The exact k-th largest of the long column ``v``, by counting ever finer ranges of it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = max(1, (high - low + 4096) // 4096)
        ranges = values.filter(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - F.lit(low)) / F.lit(width)).cast("long").alias("r")).count().collect()
        for r in sorted(ranges, key=lambda r: -r.r):
            if k <= r["count"]:
                low, high = low + r.r * width, min(high, low + (r.r + 1) * width - 1)
                break
            k -= r["count"]
    return low


def _keys(docs: DataFrame, model: Model | None, p: str, key: str) -> DataFrame:
    """``docs`` with each row's probability of being good and its key, which is null for blank texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(p, F.lit(1.0) if model is None else model.probability(text))
    # uniform in (0, 1), from the row alone
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    gumbel = F.log(F.greatest(F.col(p), F.lit(1e-300))) - F.log(-F.log(u))
    return out.withColumn(key, F.when(text.rlike(SOME_TEXT), F.round(gumbel * _SCALE).cast("long")))


def _least_key(keys: DataFrame) -> int:
    """The least key that is sampled, of rows with ``v``, the key, and ``p``."""
    n, k = keys.agg(F.count("*"), F.round(F.sum("p"))).first()
    return kth_largest(keys, min(n, int(k))) if n and k >= 1 else 2**62


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that importance resampling keeps, with their columns.

    A row's weight is target over raw probability, from the mean log ratio of its hashed words and word pairs
    under the two models as calibrated on labelled rows; over the share of good rows it is the row's
    probability of being good. Gumbel noise that is a hash of the row is added to the log weight, and the k
    rows of the largest keys are kept: a sample without replacement in proportion to the weights. k is the
    sum of the probabilities, the expected number of good rows. Rows tied with the k-th, repeated ones among
    them, are kept as well. Null texts and those of white space alone are rejected. Whole texts are read,
    however long. Null and repeated ``doc_id`` are rows like others; only a labelled ``doc_id`` fits the model. Without labels of both kinds all other rows
    have equal weights and are kept. No rows give no rows.
    """
    p, key = free_name(docs, "p_good"), free_name(docs, "gumbel_key")
    out = _keys(docs, fit(docs, labels), p, key)
    least = _least_key(cut(out.filter(F.col(key).isNotNull()).select(F.col(key).alias("v"), F.col(p).alias("p"))))
    return out.filter(F.col(key) >= F.lit(least)).select(*own(docs))


def quality_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_good, gumbel_key) of the rows that ``resample`` keeps, in each of its cases; other columns aren't read."""
    slim = docs.select("doc_id", "text")
    rows = cut(_keys(slim, fit(slim, labels), "p", "v").filter("v is not null").select("doc_id", "p", "v"))
    return rows.filter(F.col("v") >= F.lit(_least_key(rows))).select("doc_id", F.col("p").alias("p_good"), (F.col("v") / F.lit(float(_SCALE))).alias("gumbel_key"))
