"""Token-id shards: a concatenated id array with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A shard is closed when it has this many ids; a longer document is a shard of its own with those before it.
SHARD_IDS = 1 << 22
#: One position in so many set bits is kept for select.
SAMPLE = 256
#: Encoded segments that a worker keeps, and the characters of the longest of them, which bounds their bytes.
KEPT_SEGMENTS = 300_000
KEPT_CHARACTERS = 48

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A coarser cut of a text than PATTERN's, at places where PATTERN always cuts.
_SEGMENT = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


@dataclass
class EliasFano:
    """A rising sequence of n offsets below a universe, in about 2 + log2(universe / n) bits each."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, offsets: np.ndarray) -> EliasFano:
        n = len(offsets)
        universe = int(offsets[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        place = np.arange(width, dtype=np.uint64)
        values = offsets.astype(np.uint64)
        low = np.packbits(((values[:, None] >> place) & np.uint64(1)).astype(np.uint8), bitorder="little") if width else np.empty(0, np.uint8)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """The i-th offset, from 0: the nearest sampled set bit, then a scan of fewer than SAMPLE set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, np.uint32)[i // SAMPLE])
        rest = i % SAMPLE
        if rest:
            byte = at // 8
            words = np.frombuffer(self.high, np.uint8)
            skip = at % 8
            span = 64
            while True:
                ones = np.flatnonzero(np.unpackbits(words[byte : byte + span], bitorder="little")[skip:])
                if len(ones) > rest:
                    at += int(ones[rest])
                    break
                span *= 2
        return ((at - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        last = first + self.low_bits
        piece = int.from_bytes(self.low[first // 8 : (last + 7) // 8], "little")
        return (piece >> first % 8) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All offsets."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1)
            out = out | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


class BytePairs(dict):
    """Maps a segment of text to its ids, packed; equal segments are encoded once."""

    def __init__(self, ranks: dict[bytes, int], dtype):
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = dtype

    def __missing__(self, segment: str) -> bytes:
        out = np.array(self.encoding.encode_ordinary(segment), self.dtype).tobytes()
        if len(segment) <= KEPT_CHARACTERS:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _SEGMENT.findall(text)))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def id_type(ranks: dict[bytes, int]):
    """Two bytes an id where the vocabulary allows it, else four."""
    return np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32


_coders: dict[str, BytePairs] = {}

SHARD = "shard long, n_docs long, n_ids long, id_bytes int, doc_ids array<long>, ids binary, low_bits int, low binary, high binary, samples binary"


def _shards(shared, shard_ids: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if key not in _coders:  # once a worker process
            _coders.clear()
            _coders[key] = BytePairs(shared.value, id_type(shared.value))
        coder = _coders[key]
        each = np.dtype(coder.dtype).itemsize
        task, count = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        packed: list[bytes] = []
        ends = [0]

        def close() -> pa.RecordBatch:
            ef = EliasFano.encode(np.array(ends, np.int64))
            row = [(task << 32) + count, len(docs), ends[-1], each, list(docs), b"".join(packed), ef.low_bits, ef.low, ef.high, ef.samples]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            docs.clear()
            packed.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            for a in range(0, len(b), 512):
                part = b.slice(a, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    piece = coder.encode(text or "")
                    docs.append(doc)
                    packed.append(piece)
                    ends.append(ends[-1] + len(piece) // each)
                    if ends[-1] >= shard_ids:
                        yield close()
                        count += 1
        if docs:
            yield close()

    return run


def write_shards(docs: DataFrame, ranks: str = RANKS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of token ids of all rows of ``docs``, in the order in which its partitions hold them.

    A row is a shard: ``ids`` is the concatenation of its documents' ids, ``doc_ids`` names them, and
    ``low``, ``high`` and ``samples`` are the Elias-Fano code of its n_docs + 1 boundaries, with which
    ``EliasFano.select`` gives any offset. Nothing is shuffled; shard numbers tell the partition and the place
    in it. Null and empty texts are documents of no ids; long ones are encoded whole. Repeated rows and null ``doc_id`` are kept as they
    are. Other columns aren't read. No rows give no shards.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_shards(shared, shard_ids), SHARD)


def boundaries(row) -> EliasFano:
    """The boundaries of a shard row."""
    return EliasFano(row["n_docs"] + 1, row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))


def document(row, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard row, found by two selects."""
    ef = boundaries(row)
    a, b = ef.select(i), ef.select(i + 1)
    kind = np.uint16 if row["id_bytes"] == 2 else np.uint32
    return np.frombuffer(bytes(row["ids"]), kind)[a:b]


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of all documents of ``shards``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], np.uint16 if row["id_bytes"] == 2 else np.uint32).astype(np.int32)
                ends = pa.array(boundaries(row).decode().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids))], ["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<int>")
