"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, forest
from .shared import join_checked, rewritten

#: Vectors of at least this cosine are near-duplicates.
THRESHOLD = 0.95
#: Neighbours after each vector, in a pass's order, that it is compared with.
WINDOW = 64
#: Share of the pairs at the threshold that the passes are to find together.
RECALL = 0.97
#: Random one-bit hashes in a pass's key; the number of the pass stands above them.
KEY_BITS = 52
#: Vectors in dense regions that are compared with each other outright; of more, dense regions get more passes first.
COMPARED = 1 << 17
#: Vectors in a block of that comparison.
BLOCK = 4096
SEED = 5


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has been in a common window with probability ``recall``, if cells are even.

    A pair is in a common window if it agrees in the first hashes that split ``n`` vectors into runs shorter
    than a window; each agrees with probability 1 - angle / pi.
    """
    agree = _agree(threshold)
    depth = max(0.0, math.log2(max(n, 2) / (window / 2)))
    one = agree**depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one < 1 else 1


def _agree(threshold: float) -> float:
    """Probability that a pair at the threshold agrees in a hash."""
    return 1 - math.acos(min(1.0, threshold)) / math.pi


def depths(key: np.ndarray, window: int) -> np.ndarray:
    """First hashes of each sorted row that bring its run, the rows of its pass that agree in them, to a window at most.

    It is over ``KEY_BITS`` for a run that all hashes leave longer, and 0 in a pass of so few rows.
    """
    n = len(key)
    if n <= window:
        return np.zeros(n, np.int32)
    common = np.maximum(-1, KEY_BITS - np.frexp((key[:-window] ^ key[window:]).astype(np.float64))[1])  # of the window that starts at each row
    around = np.concatenate([np.full(window, -1), common, np.full(window, -1)])
    return (np.lib.stride_tricks.sliding_window_view(around, window + 1).max(axis=1) + 1).astype(np.int32)


def _units(dim: int):
    """The rows that have a direction in ``dim`` dimensions, at length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sized = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
            ids, vectors = b.column(0).filter(sized), b.column(1).filter(sized)
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls are nan
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], ["vec_id", "v"])

    return run


def coded(x: np.ndarray) -> np.ndarray:
    """(n, 8 + dim) bytes: each unit vector's scale, the length of its rounding error, and its values in a byte each."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-12).astype(np.float32) / np.float32(127)
    values = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x.astype(np.float64) - values * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)).astype(np.float32)
    return np.concatenate([scale[:, None].view(np.uint8), error[:, None].view(np.uint8), values.view(np.uint8)], axis=1)


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``coded`` and the lengths of their errors."""
    scale, error = (np.ascontiguousarray(codes[:, a : a + 4]).view(np.float32) for a in (0, 4))
    return codes[:, 8:].view(np.int8).astype(np.float32) * scale, error[:, 0]


def _binary(codes: np.ndarray) -> pa.Array:
    ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])


def _bytes(arr: pa.Array, width: int) -> np.ndarray:
    arr = arr.cast(pa.binary())
    ends = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(arr), width)


def _keys(dim: int, passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dim, passes * KEY_BITS)).astype(np.float32)
        weight = 2.0 ** np.arange(KEY_BITS - 1, -1, -1)
        for b in batches:
            for a in range(0, len(b), 1024):
                part = b.slice(a, 1024)
                x = np.asarray(part.column(1).flatten(), dtype=np.float32).reshape(-1, dim)
                bits = (x @ planes >= 0).reshape(len(x), passes, KEY_BITS)
                codes = _binary(coded(x))
                for p in range(passes):
                    key = (bits[:, p] @ weight).astype(np.int64) | np.int64(p) << np.int64(KEY_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), codes], ["key", "node", "code"])

    return run


#: Kinds of the rows that ``_compare`` gives: pairs (u, w) that are near, and that are too close to the threshold to
#: tell by their codes; of node u in pass w the depth ``n``; of partition n the w-th first row and w-th last row, node u,
#: and its number of rows, u.
NEAR, OPEN, DEPTH, FIRST, LAST, SIZE = range(6)
_FOUND = "kind int, u long, w long, n int, key long, code binary"


def _rows(kind: int, u: np.ndarray, w: np.ndarray | None = None, n=None, key=None, code=None) -> pa.RecordBatch:
    k = len(u)
    fill = lambda x, t: pa.nulls(k, t) if x is None else pa.array(np.broadcast_to(np.asarray(x, t.to_pandas_dtype()), (k,)))
    columns = [fill(kind, pa.int32()), fill(u, pa.int64()), fill(w, pa.int64()), fill(n, pa.int32()), fill(key, pa.int64()), pa.nulls(k, pa.binary()) if code is None else _binary(code)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOUND.split(", ")])


def _compare(dim: int, window: int, threshold: float, link: bool):
    """What each sorted partition tells by itself, and its first and last ``window`` rows; see ``NEAR``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, size = TaskContext.get().partitionId(), 0
        tail, told, first = None, 0, 0
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.slice(a, 4096)
                own = np.asarray(part.column(0)), np.asarray(part.column(1)), _bytes(part.column(2), dim + 8)
                if first < window:  # the partition's first rows
                    key, node, codes = (y[: window - first] for y in own)
                    yield _rows(FIRST, node, np.arange(first, first + len(node)), task, key, codes)
                    first += len(node)
                size += len(own[0])
                old = 0 if tail is None else len(tail[0])
                if old:
                    own = tuple(np.concatenate(y) for y in zip(tail, own))
                key, node, codes = own
                yield from near_rows(key, node, codes, old, window, threshold, link)
                # rows whose windows are all there; of the others some rows are kept before them
                ready = len(key) - window
                if ready > told:
                    yield _rows(DEPTH, node[told:ready], key[told:ready] >> KEY_BITS, depths(key, window)[told:ready])
                    told = ready
                before = max(0, told - window)
                tail, told = tuple(y[before:] for y in own), told - before
        if tail is not None:
            key, node, codes = tail
            yield _rows(DEPTH, node[told:], key[told:] >> KEY_BITS, depths(key, window)[told:])
            key, node, codes = (y[-window:] for y in tail)
            yield _rows(LAST, node, np.arange(len(node))[::-1], task, key, codes)
            yield _rows(SIZE, np.array([size]), None, task)

    return run


def near_rows(key: np.ndarray, node: np.ndarray, codes: np.ndarray, old: int, window: int, threshold: float, link: bool) -> Iterator[pa.RecordBatch]:
    """``NEAR`` and ``OPEN`` rows of the pairs of sorted rows, the second from ``old`` on; with ``link``, a forest of the near ones."""
    x, error = decoded(codes)
    pairs: dict[int, list[np.ndarray]] = {NEAR: [], OPEN: []}
    for u, v, sure in neighbours(key, node, x, error, old, window, threshold):
        pairs[NEAR].append(np.stack([u[sure], v[sure]]))
        pairs[OPEN].append(np.stack([u[~sure], v[~sure]]))
    for kind, some in pairs.items():
        u, v = np.concatenate(some, axis=1) if some else np.empty((2, 0), np.int64)
        if link and kind == NEAR:
            kept = forest(u, v)
            u, v = u[kept], v[kept]
        if len(u):
            yield _rows(kind, u, v)


def neighbours(key: np.ndarray, node: np.ndarray, x: np.ndarray, error: np.ndarray, old: int, window: int, threshold: float):
    """(u, v, sure) of rows of a pass at most ``window`` apart, the second from ``old`` on, that may be near by their codes.

    The product of two vectors differs from that of their codes by at most the errors' lengths and their product.
    """
    for d in range(1, min(window, len(node) - 1) + 1):
        first = max(0, old - d)
        a, b = slice(first, len(node) - d), slice(first + d, len(node))
        product = np.einsum("ij,ij->i", x[a], x[b])
        off = error[a] + error[b] + error[a] * error[b] + np.float32(1e-5)
        good = np.flatnonzero((product + off >= threshold) & (key[a] >> KEY_BITS == key[b] >> KEY_BITS) & (node[a] != node[b]))
        if len(good):
            u, v = node[a][good], node[b][good]
            yield np.minimum(u, v), np.maximum(u, v), (product - off)[good] >= threshold


def borders(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """(n, to, take, after): of partition n the last ``take`` rows, with ``after`` rows between them and partition ``to``.

    ``sizes`` has the partitions in use, in their order, with their rows. Each partition but the first gets
    the ``window`` rows before it, from as many partitions as have them.
    """
    out = []
    for k in range(1, len(sizes)):
        after, j = 0, k - 1
        while after < window and j >= 0:
            take = min(sizes[j][1], window - after)
            out.append((sizes[j][0], sizes[k][0], take, after))
            after, j = after + take, j - 1
    return out


def _passes(vectors: DataFrame, dim: int, passes: int, threshold: float, window: int, seed: int, link: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v) of the near pairs of some passes; of those that codes can't tell; and (node, miss): the log of the chance
    that the passes all miss a pair of the node."""
    keyed = vectors.mapInArrow(_keys(dim, passes, seed), "key long, node long, code binary")
    ordered = keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = rewritten(ordered.mapInArrow(_compare(dim, window, threshold, link), _FOUND))
    sizes = sorted((r.n, r.u) for r in found.filter(F.col("kind") == SIZE).select("n", "u").collect())

    def across(key, rows):
        import pandas as pd

        rows = rows.sort_values("pos")
        k, node = rows.key.to_numpy(), rows.u.to_numpy()
        codes = np.frombuffer(b"".join(rows.code), np.uint8).reshape(len(rows), dim + 8)
        out = [b.select(["kind", "u", "w", "n"]).to_pandas() for b in near_rows(k, node, codes, int((rows.pos < 0).sum()), window, threshold, link)]
        return pd.concat([*out, pd.DataFrame({"kind": DEPTH, "u": node, "w": k >> KEY_BITS, "n": depths(k, window)})])

    schema = "kind int, u long, w long, n int"
    told = found.select("kind", "u", "w", "n")
    if len(sizes) > 1:
        plan = vectors.sparkSession.createDataFrame(borders(sizes, window), "n int, to int, take int, after int")
        left = join_checked(found.filter(F.col("kind") == LAST), plan, "n", "inner").filter("w < take").select("to", (-1 - F.col("after") - F.col("w")).alias("pos"), "u", "key", "code")
        right = found.filter((F.col("kind") == FIRST) & (F.col("n") > sizes[0][0])).select(F.col("n").alias("to"), F.col("w").alias("pos"), "u", "key", "code")
        told = told.unionByName(left.unionByName(right).groupBy("to").applyInPandas(across, schema))
    pairs = lambda kind: told.filter(F.col("kind") == kind).select("u", F.col("w").alias("v")).distinct()
    one = F.least(F.when(F.col("n") > KEY_BITS, 0.0).otherwise(F.pow(F.lit(_agree(threshold)), F.col("n").cast("double"))), F.lit(1 - 1e-12))
    depth = told.filter(F.col("kind") == DEPTH).select(F.col("u").alias("node"), "w", "n").repartition("node")
    miss = depth.groupBy("node", "w").agg(F.max("n").alias("n")).groupBy("node").agg(F.sum(F.log1p(-one)).alias("miss"))
    return pairs(NEAR), pairs(OPEN), miss


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (u, v) whose vectors are near."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = (np.asarray(z.flatten(), dtype=np.float32).reshape(len(z), -1) for z in (x, y))
        return pa.array(np.einsum("ij,ij->i", a, b) >= np.float32(threshold))

    side = lambda n, v: vectors.select(F.col("node").alias(n), F.col("v").alias(v))
    return pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").filter(near("x", "y")).select("u", "v")


def near_pairs(vectors: DataFrame, dim: int, n: int, threshold: float, window: int, recall: float, seed: int, compared: int = COMPARED, link: bool = False) -> DataFrame:
    """(u, v) with u < v of verified pairs; ``vectors`` has ``node`` and unit vectors ``v``.

    A pass sends each vector as a byte a dimension. Vectors are compared with their neighbours in the order of
    all rows, whatever partitions these are in. Codes tell whether a pair is near but for those very close to
    the threshold, whose vectors are fetched.

    The first passes are as many as even cells need. Each measures how crowded every vector is; those whose
    pairs the passes so far find with less than ``recall`` go on among themselves, as of a pair with another
    vector that one has recall enough. They get twice as many passes while there are more than ``compared``
    of them and each round settles a tenth at least; the rest are compared outright, and of these only so
    many pairs are given as join what all of them would. With ``link`` so are the pairs of passes.
    """
    passes = passes_for(n, threshold, window, recall)
    pairs, unsure, miss = _passes(vectors, dim, passes, threshold, window, seed, link)
    crowded = lambda v, m: rewritten(v.join(m.filter(F.col("miss") > math.log(1 - recall)), "node").select("node", "v", "miss"))
    left = crowded(vectors, miss)
    size, before = left.count(), math.inf
    while compared < size <= 0.9 * before:
        passes, seed, before = 2 * passes, seed + 1, size
        more, doubtful, miss = _passes(left.select("node", "v"), dim, passes, threshold, window, seed, link)
        pairs, unsure = pairs.unionByName(more), unsure.unionByName(doubtful)
        miss = left.select("node", F.col("miss").alias("old")).join(miss, "node").select("node", (F.col("old") + F.col("miss")).alias("miss"))
        left = crowded(left.select("node", "v"), miss)
        size = left.count()
    if size:  # pairs of two of these are compared below
        mark = left.select("node").distinct()
        unsure = join_checked(unsure, mark.select(F.col("node").alias("u"), F.lit(True).alias("a")), "u", "left")
        unsure = join_checked(unsure, mark.select(F.col("node").alias("v"), F.lit(True).alias("b")), "v", "left").filter("a is null or b is null").select("u", "v")
    pairs = pairs.unionByName(verified(unsure.distinct(), vectors, threshold))
    return (pairs.unionByName(joining_pairs(left, size, threshold)) if size else pairs).distinct()


def joining_pairs(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(u, v) with u < v of pairs that join what all pairs at the threshold join, found by comparing all ``n`` vectors."""
    blocks = -(-n // BLOCK)
    sides = vectors.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    sides = sides.select("node", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(key, rows):
        import pandas as pd

        x, node = np.stack(rows.v.to_numpy()).astype(np.float32), rows.node.to_numpy()
        first, second = np.flatnonzero(rows.own == key[0]), np.flatnonzero(rows.own == key[1])
        u, v = joining(x, first, second, threshold)
        return pd.DataFrame({"u": np.minimum(node[u], node[v]), "v": np.maximum(node[u], node[v])}, dtype="int64")

    groups = sides.repartition(min(512, blocks * (blocks + 1) // 2), "lo", "hi").groupBy("lo", "hi")
    return groups.applyInPandas(compare, "u long, v long")


def joining(x: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``first`` and one of ``second`` at the threshold, without those that others join already."""
    group, u, v = np.arange(len(x)), [], []
    y = x[second]
    for a in range(0, len(first), 256):
        for i, near in zip(first[a : a + 256], x[first[a : a + 256]] @ y.T >= threshold):
            k = second[near]
            k = k[group[k] != group[i]]
            if len(k):
                of, at = np.unique(group[k], return_index=True)
                u.append(np.full(len(at), i))
                v.append(k[at])
                group[np.isin(group, of)] = group[i]
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, group_id, n_copies) of every vector: its group's least ``vec_id``, and the group's size.

    Groups are the connected components of pairs of cosine ``threshold`` or more that were neighbours in some
    pass, or were compared outright; equal vectors are brought together exactly, whatever their number, before
    the passes. Vectors that are too crowded for the passes to find their pairs with ``recall`` get more passes
    or are compared with each other, see ``near_pairs``; so recall holds at every size and density, and the
    pairs don't depend on how rows are partitioned.

    Vectors that are null, empty, of another length than most, all zero, or not finite are alone in their
    groups. Rows that share a ``vec_id`` are one item that is in all their groups' component. Rows of a null
    ``vec_id`` are left out. Other columns aren't read. No rows give no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e")).filter("vec_id is not null")
    sizes = rows.groupBy(F.size("e").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), "dim").limit(1).collect()
    ids = rows.select("vec_id").distinct()
    if not sizes:
        return ids.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(1).cast("long").alias("n_copies"))
    dim = sizes[0].dim
    unit = rows.mapInArrow(_units(dim), "vec_id long, v array<float>")
    # equal vectors have equal hashes of 128 bits, so that they meet without being sent
    h = [F.xxhash64(F.lit(SEED + k), "v").alias(f"h{k}") for k in range(2)]
    member = rewritten(unit.select("vec_id", *h).withColumn("same", F.min("vec_id").over(Window.partitionBy("h0", "h1"))))
    vectors = join_checked(unit, member.filter("vec_id <> same").select("vec_id").distinct(), "vec_id", "left_anti").select(F.col("vec_id").alias("node"), "v")
    n, lone, shared = member.agg(F.count("*"), F.count_distinct("vec_id"), F.count_if(F.col("vec_id") != F.col("same"))).first()
    if lone < n:  # some rows share an id, so that a vector of theirs that leads its equals may have been left out, or be there twice
        vectors = unit.select("*", *h).join(member.filter("vec_id = same").select("vec_id", "h0", "h1").distinct(), ["vec_id", "h0", "h1"]).dropDuplicates(["vec_id", "h0", "h1"]).select(F.col("vec_id").alias("node"), "v")
    near = near_pairs(vectors, dim, n - shared, threshold, window, recall, seed, link=True)
    edges = near.unionByName(member.filter("vec_id <> same").select(F.col("same").alias("u"), F.col("vec_id").alias("v")))
    root = components(edges).select(F.col("node").alias("vec_id"), "root")
    out = ids.join(root, "vec_id", "left").select("vec_id", F.coalesce("root", "vec_id").alias("group_id"))
    return out.join(out.groupBy("group_id").agg(F.count("*").alias("n_copies")), "group_id").select("vec_id", "group_id", "n_copies")
