"""SimHash near-duplicates by segments that differ in at most one bit."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .textbuf import WORDS_ONLY, blocks, lowered, mix, string_buffers, tokens

BITS = 256
#: Signatures at most this far apart are near-duplicates.
MAX_DISTANCE = 32
#: Share of the pairs at that distance, of random bits, that the segments are to find.
RECALL = 0.97
#: Segments of a cut where signatures are few; where they are many, fewer and longer segments of more cuts.
SEGMENTS = 12
FEWEST_SEGMENTS = 5
#: By the pigeonhole principle some of ``SEGMENTS`` segments of two signatures this far apart differs in at most one bit.
CERTAIN = 2 * SEGMENTS - 1
#: Bits of a code for half a segment.
HALF_BITS = 26
#: Comparisons that cost as much as a row that is sent.
ROW_COST = 50
#: About so many signatures tell how far apart unrelated ones are; they set the cost and no result.
SAMPLED = 2048
#: Pairs that a worker compares at once.
AT_ONCE = 1 << 20
SEED = 3

_SEEDS = [np.uint64(0xA0761D6478BD642F * (i + 1) & (2**64 - 1)) for i in range(BITS // 64)]
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def missed(segments: int, distance: int) -> float:
    """Chance that no segment of one cut differs in at most one bit, for so many differing bits at random places."""
    length = BITS // segments
    ways = [math.comb(BITS - segments * length, k) for k in range(distance + 1)]  # by the bits that are placed so far
    for _ in range(segments):
        ways = [sum(ways[k - j] * math.comb(length, j) for j in range(2, min(k, length) + 1)) for k in range(distance + 1)]
    return ways[distance] / math.comb(BITS, distance)


def cuts_for(segments: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> int:
    """Cuts of permuted bits that together find a pair at ``distance`` with probability ``recall``."""
    miss = missed(segments, distance)
    return 1 if miss <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(miss))


def planned(n: int, apart: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[int, int]:
    """(segments, cuts) of the least cost for ``n`` signatures; ``apart`` counts sampled pairs by their distance.

    Shorter segments bring more unrelated signatures together, which grows with ``n``; longer ones need more
    cuts for the same recall, and each segment of each cut is two rows a signature. Recall is the same for all.
    """
    far = apart.astype(np.float64).copy()
    far[: distance + 1] = 0  # the near ones meet at any cost
    share = far / max(apart.sum(), 1)
    best = None
    for segments in range(SEGMENTS, FEWEST_SEGMENTS - 1, -1):
        cuts, length = cuts_for(segments, distance), BITS // segments
        meet = sum(x * (math.comb(BITS - length, d) + (length * math.comb(BITS - length, d - 1) if d else 0)) / math.comb(BITS, d) for d, x in enumerate(share) if x)
        cost = cuts * segments * (2 * ROW_COST + n * meet / 2)
        if best is None or cost < best[0]:
            best = cost, segments, cuts
    return best[1:]


def _words_or_pairs(h: np.ndarray, row: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The tokens' hashes; a character of an unspaced script is taken with the next one, if that is such a character too."""
    both = np.zeros(len(h), bool)
    both[:-1] = alone[:-1] & alone[1:] & (row[:-1] == row[1:])
    nxt = np.append(h[1:], _PAIR)
    return np.where(both, mix(h * _PAIR + nxt), h)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) signed words of the signatures, and which rows have one: those that aren't null or blank.

    Features are the words of the whole text in lower case, and in scripts without spaces the pairs of
    neighbouring characters, weighted by the square root of their count. A text of punctuation alone has a
    signature that is a hash of it, which equal texts share.
    """
    out, has = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), bool)
    for first, raw, offsets in blocks(lowered(texts)):
        h, row, _, alone = tokens(raw, offsets, WORDS_ONLY, with_alone=True)
        if not len(h):
            continue
        h = _words_or_pairs(h, row, alone)
        # a block has under 2^20 rows, as each text in it but one has a byte at least, or is empty and has no word
        _, local = np.unique(row, return_inverse=True)
        key = np.sort((local.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        weight = np.sqrt(np.diff(start, append=len(key))).astype(np.float32)
        key = key[start]
        word, doc = key & np.uint64((1 << 44) - 1), key >> np.uint64(44)
        code = np.stack([mix(word + s) for s in _SEEDS], axis=1).view(np.uint8)
        docs = first + np.unique(row)
        cuts = np.searchsorted(doc, np.arange(len(docs) + 1, dtype=np.uint64))
        for k, d in enumerate(docs):
            total = np.zeros(BITS, np.float32)
            weights = weight[cuts[k] : cuts[k + 1]]
            for a in range(0, len(weights), 1 << 14):
                total += weights[a : a + (1 << 14)] @ np.unpackbits(code[cuts[k] + a : min(cuts[k + 1], cuts[k] + a + (1 << 14))], axis=1).astype(np.float32)
            out[d] = np.packbits(2 * total >= weights.sum()).view(np.uint64)
        has[docs] = True
    wordless = np.flatnonzero(~has)
    if len(wordless):
        raw, offsets = string_buffers(texts.take(pa.array(wordless)))
        for d, a, b in zip(wordless, offsets[:-1], offsets[1:]):
            text = raw[a:b].tobytes()
            if text.decode("utf-8", "replace").strip():
                out[d] = np.frombuffer(hashlib.blake2b(text, digest_size=BITS // 8).digest(), np.uint64)
                has[d] = True
    return out.view(np.int64), has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, has = signatures(b.column(1))
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), *(pa.array(words[has, i]) for i in range(BITS // 64))], ["doc_id", *WORDS])


def permutation(cut_: int) -> np.ndarray:
    """The order of the bits in a cut; the first cut takes them as they are."""
    return np.random.default_rng((SEED, cut_)).permutation(BITS) if cut_ else np.arange(BITS)


def halves(segments: int, cuts: int) -> list[np.ndarray]:
    """For each cut, (BITS, 2 x segments) powers of two; bits times these are the two halves of each segment."""
    length, out = BITS // segments, []
    for c in range(cuts):
        power = np.zeros((BITS, 2 * segments))
        order = permutation(c)
        for s in range(segments):
            own = order[s * length : (s + 1) * length]
            for k, half in enumerate((own[: length // 2], own[length // 2 :])):
                power[half, 2 * s + k] = 2.0 ** np.arange(len(half))
        out.append(power)
    return out


def _routes(segments: int, cuts: int):
    """Each node once for each half of each segment, with a code of the segment, that half and the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = halves(segments, cuts)
        shift = np.int64(HALF_BITS)
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.slice(a, 4096)
                words = np.stack([np.asarray(part.column(1 + i)) for i in range(BITS // 64)], axis=1)
                bits = np.unpackbits(words.view(np.uint8), axis=1).astype(np.float64)
                for c, power in enumerate(powers):
                    both = (bits @ power).astype(np.int64)
                    for s in range(2 * segments):
                        code = (np.int64(2 * segments * c + s) << (shift + shift)) | (both[:, s] << shift) | both[:, s ^ 1]
                        yield pa.RecordBatch.from_arrays([pa.array(code), *part.columns], ["code", "node", *WORDS])

    return run


def _compare(max_distance: int, width: int, link: bool):
    """Verified pairs of the nodes that share a one-wildcard variant of a segment; rows are sorted by code.

    With ``link``, each node of a set of pairs with the least node that they join it to, instead of the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            own = tuple(np.asarray(c) for c in b.columns)
            if kept is not None:
                own = tuple(np.concatenate(x) for x in zip(kept, own))
            whole = np.searchsorted(own[0], own[0][-1] >> HALF_BITS << HALF_BITS) if len(own[0]) else 0  # the last half may go on
            yield from found(tuple(x[:whole] for x in own))
            kept = tuple(x[whole:] for x in own)
        if kept is not None:
            yield from found(kept)

    def found(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        code, node = rows[0], rows[1]
        words = np.stack(rows[2:], axis=1).view(np.uint64)
        for i, j in together(code, width):
            near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= max_distance
            u, v = node[i[near]], node[j[near]]
            other = u != v
            u, v = np.minimum(u[other], v[other]), np.maximum(u[other], v[other])
            if link:
                u, v = linked(u, v)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (least node, node) that join what the pairs (u, v) join, one for each node that isn't the least of its set."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (root[a], root[b], a, b):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def together(code: np.ndarray, width: int = HALF_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs whose sorted codes differ in at most one bit of the other half; equal ones once a segment.

    For each wildcard, codes with a 0 there are looked up with a 1 in its place: an equality join of the
    variants that have this bit as their wildcard.
    """
    n = np.arange(len(code))
    rows, start, count = [], [], []
    for bit in range(-1, width):
        if bit < 0:
            of = n[(code >> (2 * HALF_BITS)) % 2 == 0]
            first, last = of + 1, np.searchsorted(code, code[of], "right")
        else:
            of = n[(code >> bit) % 2 == 0]
            other = code[of] | (1 << bit)
            first, last = np.searchsorted(code, other), np.searchsorted(code, other, "right")
        some = last > first
        rows.append(of[some])
        start.append(first[some])
        count.append((last - first)[some])
    rows, start, count = (np.concatenate(x) for x in (rows, start, count))
    ends = np.cumsum(count)
    a = 0
    while a < len(rows):
        done = ends[a] - count[a]
        b = max(a + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        i = np.repeat(rows[a:b], count[a:b])
        yield i, np.arange(len(i)) + np.repeat(start[a:b] - (ends[a:b] - count[a:b] - done), count[a:b])
        a = b


WORDS = [f"s{i}" for i in range(BITS // 64)]


def _met(nodes: DataFrame, max_distance: int, segments: int, cuts: int, link: bool) -> DataFrame:
    # All one-wildcard variants of a segment but those of one half hold the other half whole, so nodes are sent by
    # each half, and the variants are made and joined where the halves meet.
    width = BITS // segments - BITS // segments // 2
    routed = nodes.select("node", *WORDS).mapInArrow(_routes(segments, cuts), "code long, node long, " + ", ".join(f"{w} long" for w in WORDS))
    return routed.repartition(F.shiftright("code", HALF_BITS)).sortWithinPartitions("code").mapInArrow(_compare(max_distance, width, link), "u long, v long").distinct()


def near_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, cuts: int = 1) -> DataFrame:
    """(u, v) with u < v of the nodes whose signatures are at most ``max_distance`` apart.

    ``nodes`` has ``node`` and the words of its signature, which differ from row to row. All pairs up to
    2 x ``segments`` - 1 apart are found; those beyond are found when some segment of some cut differs in at
    most one bit.
    """
    return _met(nodes, max_distance, segments, cuts, False)


def distances(words: np.ndarray) -> np.ndarray:
    """How many of the pairs of some signatures are 0, 1, ... ``BITS`` apart."""
    out = np.zeros(BITS + 1, np.int64)
    for a in range(0, len(words), 256):
        apart = np.bitwise_count(words[a : a + 256, None] ^ words[None]).sum(axis=2)
        out += np.bincount(apart[np.arange(len(words))[None] > np.arange(a, a + len(apart))[:, None]], minlength=BITS + 1)
    return out


def duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, and the one of its group that stays.

    Groups are the connected components of near pairs; the least ``doc_id`` of a group stays. Documents
    without near-duplicates aren't in the result. Null and blank texts are nobody's duplicate; texts of
    punctuation alone are duplicates of equal ones. Whole texts are read, however long. Rows without a
    ``doc_id`` aren't compared. Rows that share a ``doc_id`` are one document, which goes if any of its texts
    has a near-duplicate with a lesser ``doc_id``; equal rows alone don't make it go. Ties don't arise, as
    ids are compared. Other columns of ``docs`` aren't read. No rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    signed = texts.mapInArrow(_sign, "doc_id long, " + ", ".join(f"{w} long" for w in WORDS))
    # a node is a signature, by the least document that has it; a document with two signatures can be two rows of a node
    same = Window.partitionBy(*WORDS).orderBy("doc_id")
    member = cut(signed.select("*", F.first("doc_id").over(same).alias("least"), (F.row_number().over(same) == 1).alias("leads")))
    nodes = member.filter("leads").select(F.col("least").alias("node"), *WORDS)
    n = nodes.count()
    sample = nodes.filter(F.pmod(F.xxhash64(F.lit(SEED), *WORDS), F.lit(1 << 30)) < min(1 << 30, (SAMPLED << 30) // max(n, 1))).select(*WORDS).toArrow()
    words = np.stack([np.asarray(sample.column(w)) for w in WORDS], axis=1).view(np.uint64) if len(sample) else np.zeros((0, len(WORDS)), np.uint64)
    least = cut(components(_met(nodes, max_distance, *planned(n, distances(words), max_distance), True)))
    root = member.select("doc_id", "least").join(least.withColumnRenamed("node", "least"), "least", "left").select("doc_id", F.coalesce("root", "least").alias("root"))
    return root.filter(F.col("doc_id") != F.col("root")).groupBy("doc_id").agg(F.min("root").alias("duplicate_of"))
