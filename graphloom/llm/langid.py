"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SOME_TEXT, free_name, own
from .textbuf import blocks, row_sums

#: The longest context, in bytes.
ORDER = 4
#: Contexts that are seen at less than this share of a language's sample, in every language, are left out of the trees.
#: So a language has at most 1 / LEAST_SHARE contexts of each length, whatever the size of the sample.
LEAST_SHARE = 2e-5
#: About how many labelled texts of each language fit its model; a hash of doc_id chooses them.
TEXTS_PER_LANGUAGE = 1_000
SEED = 29
#: A text is rejected if its best model needs more bits a byte than this,
MAX_BITS = 7.0
#: or if the next model needs less than this many bits more for all of it.
LEAST_MARGIN = 1.0


@dataclass
class Trees:
    """The context trees of all languages over one set of contexts.

    A state is a context. ``step[state, symbol]`` is the longest suffix of context and symbol that is a
    context, and ``bits[state, symbol, language]`` the exact code length of the symbol after the context.
    """

    languages: list[str]
    order: int
    symbol: np.ndarray
    step: np.ndarray
    bits: np.ndarray


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            for lang in sorted(set(names)):
                texts = b.column(1).filter(pa.array([x == lang for x in names]))
                for _, raw, offsets in blocks(texts, 1 << 20):
                    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
                    code = np.zeros(len(raw), np.int64)
                    for j in range(order, -1, -1):  # older bytes first; 256 stands for the start of the text
                        old = np.full(len(raw), 256, np.int64)
                        old[j:] = raw[: max(0, len(raw) - j)]
                        code = code * 257 + np.where(place >= j, old, 256)
                    grams, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, least_seen: int | None = None, least_share: float = LEAST_SHARE) -> Trees:
    """Trees from each language's counts of order+1 bytes, packed in base 257 with 256 before the text.

    Escapes are those of method C, with exclusion of the symbols of longer contexts: after a context in which
    n symbols of u kinds were seen, a kind seen c times costs -log2(c / (n + u)) and an escape
    -log2(u / (n + u)). After the empty context the bytes left are equally likely. ``least_seen`` is a count
    in place of ``least_share``.
    """
    langs = sorted(grams)
    least = {k: least_share * n.sum() if least_seen is None else least_seen for k, (_, n) in grams.items()}
    seen = np.unique(np.concatenate([g % 257 for g, _ in grams.values()]))
    symbol = np.zeros(257, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width, none = len(seen) + 1, len(seen) + 1
    symbol[256] = none  # never a symbol of a context
    base = width + 1
    parts = {}
    for lang in langs:
        g, n = grams[lang]
        digits = [symbol[(g // 257**j) % 257] for j in range(order + 1)]  # digits[0] is the last byte
        parts[lang] = digits, n
    # contexts by depth: packed symbols, the newest least significant
    ids: list[dict[int, int]] = [{0: 0}]
    suffix, size = [0], 1
    for depth in range(1, order + 1):
        often: set[int] = set()
        for lang, (digits, n) in parts.items():
            inside = np.ones(len(n), bool)
            code = np.zeros(len(n), np.int64)
            for j in range(depth, 0, -1):
                code = code * base + digits[j]
                inside &= digits[j] != none
            codes, at = np.unique(code[inside], return_inverse=True)
            often.update(codes[np.bincount(at, n[inside], len(codes)) >= least[lang]].tolist())
        level = {}
        for c in sorted(often):
            parent = ids[depth - 1].get(c % base ** (depth - 1))
            if parent is not None:
                level[c] = size
                suffix.append(parent)
                size += 1
        ids.append(level)
    suffix = np.array(suffix, np.int32)
    depth_of = np.concatenate([np.full(len(x), d, np.int32) for d, x in enumerate(ids)])
    code_of = np.concatenate([np.fromiter(x, np.int64, len(x)) for x in ids])
    step = np.zeros((size, width), np.int32)
    for s in range(size):
        d = int(depth_of[s])
        row = step[suffix[s]].copy() if s else np.zeros(width, np.int32)
        if d < order:
            nxt, c = ids[d + 1], int(code_of[s]) * base
            for a in range(1, width):
                t = nxt.get(c + a)
                if t is not None:
                    row[a] = t
        row[0] = 0
        step[s] = row
    bits = np.zeros((size, width, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        digits, n = parts[lang]
        count = np.zeros((size, width))
        for depth, level in enumerate(ids):
            code, inside = np.zeros(len(n), np.int64), np.ones(len(n), bool)
            for j in range(depth, 0, -1):
                code = code * base + digits[j]
                inside &= digits[j] != none
            known = np.array(sorted(level), np.int64)
            if not len(known):
                continue
            at = np.searchsorted(known, code).clip(0, len(known) - 1)
            inside &= known[at] == code
            state = np.array([level[c] for c in known.tolist()])[at]
            np.add.at(count, (state[inside], digits[0][inside]), n[inside])
        cost = np.zeros((size, width))
        open_ = np.ones((size, width), bool)  # symbols that no longer context has coded
        base_cost, at = np.zeros(size), np.arange(size)
        for _ in range(order + 1):
            c = np.where(open_, count[at], 0)
            total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
            some = kinds > 0
            hit = c > 0
            cost = np.where(hit, base_cost[:, None] + np.log2(np.maximum(total + kinds, 1))[:, None] - np.log2(np.maximum(c, 1)), cost)
            open_ &= ~hit
            base_cost = base_cost + np.where(some, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0)
            at = suffix[at]  # once the empty context has had its turn, none of its kinds is open
        left = 256 - (~open_[:, 1:]).sum(axis=1)
        cost = np.where(open_, (base_cost + np.log2(np.maximum(left, 1)))[:, None], cost)
        bits[:, :, k] = cost
    return Trees(langs, order, symbol[:256], step, bits)


def train(docs: DataFrame, lang: str = "lang", order: int = ORDER, least_share: float = LEAST_SHARE, texts: int = TEXTS_PER_LANGUAGE) -> Trees | None:
    """Trees of the labelled languages of ``docs``; None without any labelled text."""
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & (F.trim(lang) != ""))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()}
    if not sizes:
        return None
    share = F.coalesce(*(F.when(F.col(lang) == k, F.lit(min(1 << 30, (texts << 30) // n))) for k, n in sorted(sizes.items())))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < share)
    rows = chosen.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").to_pylist()
    gram, n = np.asarray(rows.column("gram")), np.asarray(rows.column("n"))
    grams = {}
    for k in sorted(set(names)):
        own = np.array([x == k for x in names])
        grams[k] = gram[own], n[own]
    return build(grams, order, None, least_share) if grams else None


def code_lengths(trees: Trees, texts: pa.Array) -> np.ndarray:
    """(n, languages) bits that each model needs for each whole text."""
    out = np.zeros((len(texts), len(trees.languages)))
    step, width = trees.step.ravel(), trees.step.shape[1]
    bits = trees.bits.reshape(-1, len(trees.languages))
    for first, raw, offsets in blocks(texts, 1 << 18):
        if not len(raw):
            continue
        sym = trees.symbol[raw]
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets))
        state = np.zeros(len(raw), np.int32)
        for j in range(trees.order, 0, -1):  # the state depends on the last bytes alone
            old = np.zeros(len(raw), np.int32)
            old[j:] = sym[: max(0, len(raw) - j)]
            state = np.where(place >= j, step[state * width + old], 0)
        out[first : first + len(offsets) - 1] = row_sums(bits[state * width + sym], offsets)
    return out


def identifier(shared, max_bits: float = MAX_BITS, least_margin: float = LEAST_MARGIN):
    """A UDF from texts to (lang, bits, margin) by the trees of a broadcast; lang is null where the text is rejected."""

    @F.arrow_udf("struct<lang:string,bits:double,margin:double>")
    def identify(texts: pa.Array) -> pa.Array:
        trees = shared.value  # loaded once a worker process
        total = code_lengths(trees, texts)
        size = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.float64)
        order = np.sort(total, axis=1)
        best = total.argmin(axis=1)
        rate = order[:, 0] / np.maximum(size, 1)
        margin = order[:, 1] - order[:, 0] if total.shape[1] > 1 else np.full(len(total), np.inf)
        good = (size > 0) & (rate <= max_bits) & (margin >= least_margin)
        lang = pa.array([trees.languages[k] if g else None for k, g in zip(best.tolist(), good.tolist())], pa.string())
        return pa.StructArray.from_arrays([lang, pa.array(rate), pa.array(margin)], ["lang", "bits", "margin"])

    return identify


def _identified(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, str]:
    name = free_name(docs, "language_id")
    trees = train(labelled)
    if trees is None:
        return docs.withColumn(name, F.lit(None).cast("struct<lang:string,bits:double,margin:double>")), name
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    text = F.col("text").cast("string")
    return docs.withColumn(name, identifier(shared)(F.when(text.rlike(SOME_TEXT), text).otherwise(""))), name


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, language, bits_per_byte, margin_bits) of every row of ``docs``.

    The models are fitted to a bounded sample of labelled rows, of ``docs`` by default, and then frozen.
    Each whole text is coded by the model of every language; the shortest code wins, the first by name in a
    tie. The language is null where the text is rejected: null or blank, in no language known here (over
    ``MAX_BITS`` a byte), or undecided (a margin under ``LEAST_MARGIN`` bits). Without labelled rows all are
    rejected. Repeated rows and null ``doc_id`` give their own rows, equal texts the same answer; other columns
    aren't read. Whole texts are coded, however long. No rows give no rows.
    """
    slim = docs.select("doc_id", "text")
    out, name = _identified(slim, docs if labelled is None else labelled)
    return out.select("doc_id", F.col(f"{name}.lang").alias("language"), F.round(F.col(f"{name}.bits"), 9).alias("bits_per_byte"), F.round(F.col(f"{name}.margin"), 6).alias("margin_bits"))


def accepted(docs: DataFrame, labelled: DataFrame | None = None, lang: str | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language ``identify`` tells; null, blank and undecided ones go.

    With ``lang``, that column of ``docs`` gets the language that was told. Repeated rows stay or go together;
    a null ``doc_id`` doesn't matter. Columns keep their names, whatever these are. No rows give no rows.
    """
    out, name = _identified(docs, docs if labelled is None else labelled)
    columns = [F.col(f"{name}.lang").alias(c) if c == lang else x for c, x in zip(docs.columns, own(docs))]
    return out.filter(F.col(f"{name}.lang").isNotNull()).select(*columns)
