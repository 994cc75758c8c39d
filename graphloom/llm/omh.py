"""Order MinHash fingerprints, which are sensitive to edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import WORDS_ONLY, blocks, lowered, mix, tokens

K = 3
TUPLE = 2
SKETCHES = 32
SEED = 20_240_607

_STEP = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def kmers(h: np.ndarray, row: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row starts) of the k-mers of each row's token hashes; a row of fewer tokens is one k-mer."""
    count = np.diff(starts)
    if not len(h):
        return h, starts
    out = np.zeros(len(h), np.uint64)
    left = starts[row + 1] - np.arange(len(h))
    for j in range(k):
        inside = left > j
        nxt = np.zeros(len(h), np.uint64)
        nxt[: max(0, len(h) - j)] = h[j:]
        out = np.where(inside, mix(out * _STEP + nxt + _U(j + 1)), out)
    first = np.zeros(len(h), bool)
    first[starts[:-1][count > 0]] = True
    keep = (left >= k) | (first & (count[row] < k))
    return out[keep], np.concatenate(([0], np.cumsum(np.where(count >= k, count - k + 1, np.minimum(count, 1)))))


def occurrences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many equal values of the same row stand before each."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = mix(values + row.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(at, np.diff(at, append=len(key)))
    return out


def sketch(values: np.ndarray, occ: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """One hash for each seed: of the ``size`` values that come first in the seed's order, as they stand in the text."""
    element = mix(values * _STEP + occ.astype(np.uint64))
    take = min(size, len(values))
    out = np.empty(len(seeds), np.uint64)
    step = max(1, (1 << 20) // len(values))
    for a in range(0, len(seeds), step):
        ranks = mix(element[None, :] ^ seeds[a : a + step, None])
        at = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1) if take < len(values) else np.broadcast_to(np.arange(take), (len(ranks), take))
        acc = seeds[a : a + step].copy()
        for j in range(take):
            acc = mix(acc * _STEP + values[at[:, j]])
        out[a : a + step] = acc
    return out


def _fingerprint(k: int, size: int, sketches: int, seed: int):
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * _STEP + _U(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for first, raw, offsets in blocks(lowered(texts)):
                values, starts = kmers(*tokens(raw, offsets, WORDS_ONLY), k)
                occ = occurrences(values, starts)
                rows = [None if s == e else sketch(values[s:e], occ[s:e], seeds, size).view(np.int64) for s, e in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(rows)), pa.array(np.diff(starts), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_kmers", "signature"]
                )

    return run


def fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE, sketches: int = SKETCHES, seed: int = SEED) -> DataFrame:
    """(doc_id, n_kmers, signature) for each row of ``docs``, in one narrow pass.

    The k-mers are runs of ``k`` words in lower case, or of ``k`` characters in scripts that put no spaces
    between words, each numbered by its occurrence so that repeats count.
    For each of ``sketches`` orders the ``size`` first are put back in text order and hashed as a tuple, so
    the share of equal entries of two signatures falls with edits and with moved passages.

    Whole texts are read, however long. A text of 1 to k-1 words is one k-mer; one of fewer than ``size`` k-mers uses all it has. Null, empty
    and wordless texts have 0 k-mers and a null signature. Repeated rows and null ``doc_id`` give their own
    rows, and equal texts equal ones; ties of an order's hashes don't arise but for equal elements. Other
    columns aren't read. No rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint(k, size, sketches, seed), "doc_id long, n_kmers long, signature array<long>")
