"""Vectorised work on the raw UTF-8 buffers of Arrow string arrays.

All functions take whole texts; batches are cut between rows only, so that the temporary arrays stay
within a few cache-sized blocks however large an Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is one block of its own.
BLOCK_BYTES = 1 << 19

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64

SPACE, WORD, OTHER = 0, 1, 2

#: Byte classes: letters, digits and the bytes of non-ASCII characters are word bytes, but for those of ``_reclass``.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD
#: The same with punctuation counted as space.
WORDS_ONLY = np.where(CLASSES == WORD, WORD, SPACE).astype(np.uint8)


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n+1 offsets into them; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(arr: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that together have at most ``max_bytes``."""
    raw, offsets = string_buffers(arr)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lowered(texts: pa.Array) -> pa.Array:
    """The texts in lower case, letter by letter in all scripts; only ASCII letters of texts that aren't UTF-8."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        return pc.ascii_lower(texts)


#: Characters of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, ideographs): each is a token.
_ALONE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)]
_SPACES = [(0x1680, 0x1680), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_MARKS = [(0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3003), (0x3008, 0x3011), (0x3014, 0x301F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
_TABLE = np.zeros(1 << 16, np.uint8)  # of the characters of three bytes: 1 space, 2 mark, 3 a token of its own
for _kind, _ranges in ((1, _SPACES), (2, _MARKS), (3, _ALONE)):
    for _a, _b in _ranges:
        _TABLE[_a : _b + 1] = _kind


def _reclass(raw: np.ndarray, cls: np.ndarray, marks: int) -> np.ndarray:
    """Gives spaces and punctuation beyond ASCII their classes; positions of the characters that are tokens of their own."""
    two = np.flatnonzero(raw[:-1] == 0xC2)
    if len(two):
        low = raw[two + 1]
        for kind, at in ((SPACE, two[(low == 0x85) | (low == 0xA0)]), (marks, two[(low > 0xA0) & (low < 0xC0) & (low != 0xAA) & (low != 0xB5) & (low != 0xBA)])):
            cls[at] = cls[at + 1] = kind
    alone = np.empty(0, np.int64)
    three = np.flatnonzero((raw[:-2] & 0xF0) == 0xE0)
    if len(three):
        point = (raw[three].astype(np.int32) & 15) << 12 | (raw[three + 1].astype(np.int32) & 63) << 6 | (raw[three + 2].astype(np.int32) & 63)
        kinds = _TABLE[point]
        for kind, at in ((SPACE, three[kinds == 1]), (marks, three[kinds == 2])):
            cls[at] = cls[at + 1] = cls[at + 2] = kind
        alone = three[kinds == 3]
    four = np.flatnonzero((raw[:-3] & 0xF8) == 0xF0)
    if len(four):  # ideographs of the planes 2 and 3
        plane = (raw[four] & 7) << 2 | (raw[four + 1] >> 4) & 3
        alone = np.concatenate([alone, four[(plane == 2) | (plane == 3)]])
    return alone


def tokens(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray, with_alone: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, row, row starts) of the maximal runs of equal non-space class, in text order.

    Characters of scripts that put no spaces between words are runs of their own. Spaces and punctuation
    beyond ASCII count as such. ``row starts`` has an entry for each row and the total at its end: tokens of row r are at
    ``starts[r]:starts[r + 1]``. With ``with_alone`` a fourth array tells which are such characters.
    """
    rows = len(offsets) - 1
    if len(raw) == 0:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(rows + 1, np.int64), np.empty(0, bool))[: 3 + with_alone]
    cls = classes[raw]
    new = np.empty(len(raw), bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    inner = offsets[:-1]
    new[inner[inner < len(raw)]] = True
    alone = np.empty(0, np.int64)
    if raw.max() > 0xC1:
        alone = _reclass(raw, cls, int(classes[ord(".")]))
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        new[inner[inner < len(raw)]] = True
        if len(alone):
            new[alone] = True
            ends = alone + np.where((raw[alone] & 0xF8) == 0xF0, 4, 3)
            new[ends[ends < len(raw)]] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(starts, append=len(raw))
    power = np.full(int(lengths.max()), _PRIME, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    values = raw.astype(np.uint64)
    values += _U(1)
    values *= power[place]
    sums = np.add.reduceat(values, starts)
    real = cls[starts] != SPACE
    starts, hashes = starts[real], mix(sums[real])
    row = np.searchsorted(offsets, starts, "right") - 1
    out = hashes, row, np.searchsorted(starts, offsets, "left")
    if not with_alone:
        return out
    own = np.zeros(len(raw), bool)
    own[alone] = True
    return *out, own[starts]


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[r]:starts[r + 1]]`` for each r, along the first axis; 0 where it is empty."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    some = starts[1:] > starts[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, starts[:-1][some], axis=0, dtype=np.float64)
    return out
