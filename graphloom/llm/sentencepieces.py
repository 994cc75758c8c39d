"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Encoded segments that a worker keeps; when it has so many it begins anew.
KEPT_SEGMENTS = 100_000
#: Characters of the longest segment that is kept, which bounds the bytes of all; longer ones are solved each time.
KEPT_CHARACTERS = 48


@dataclass
class Vocabulary:
    """Pieces of a model with their scores and kinds, as read on the driver."""

    pieces: list[str]
    scores: list[float]
    bytes_: dict[int, int]
    unknown: int
    normal: list[int] = field(default_factory=list)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls(pieces, [sp.get_score(i) for i in range(n)], bytes_, sp.unk_id(), normal)


class Decoder:
    """Maps ids to the text that they stand for."""

    def __init__(self, vocabulary: Vocabulary):
        self.surface = [b""] * len(vocabulary.pieces)
        for i in vocabulary.normal:
            self.surface[i] = vocabulary.pieces[i].replace(SPACE, " ").encode()
        for b, i in vocabulary.bytes_.items():
            self.surface[i] = bytes([b])
        self.surface[vocabulary.unknown] = " \u2047 ".encode()

    def __call__(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder(dict):
    """Maps a segment of text to the ids of its best segmentation, packed as 32-bit integers.

    No piece goes from another character over to a space mark, so the best path through a text is that of its
    segments, cut before each such mark; equal segments are solved once. For a vocabulary with a piece that
    does, the whole text is one segment.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        crossing, joined = False, set()
        for i in vocabulary.normal:
            piece = vocabulary.pieces[i]
            if piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), vocabulary.scores[i], i))
            crossing |= SPACE in piece.lstrip(SPACE)
            if len(piece) > 1:
                joined.update(piece)
        self.automaton.make_automaton()
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self.cut = re.compile(r"(?s).+" if crossing else rf"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (rf"|[{alone}]" if alone else ""))
        self.worst = min((vocabulary.scores[i] for i in vocabulary.normal), default=0.0) - 10.0
        self.decode = Decoder(vocabulary)

    def __missing__(self, segment: str) -> bytes:
        out = np.array(self.viterbi(segment), np.int32).tobytes()
        if len(segment) <= KEPT_CHARACTERS:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = out
        return out

    def viterbi(self, segment: str) -> list[int]:
        """The ids of the path of the best total score; of equal ones, that whose last piece is longest, and so on back.

        The automaton yields matches by their end, through its output links from the longest to the shortest,
        so all scores before the end are final. A character that is no piece costs more than any piece and
        becomes its bytes.
        """
        n, at, worst = len(segment), 0, self.worst
        best, piece, size = [0.0] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        for last, (length, score, i) in self.automaton.iter(segment):
            end = last + 1
            while at < end:
                at += 1
                best[at] = best[at - 1] + worst
            total = best[end - length] + score
            if total > best[end] or (total == best[end] and length > size[end]):
                best[end], piece[end], size[end] = total, i, length
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.v.bytes_:
                ids.extend(self.v.bytes_[b] for b in reversed(segment[at - 1].encode()))
            else:
                ids.append(self.v.unknown)
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))

_encoders: dict[str, Encoder] = {}


def _run(shared):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:  # once a worker process
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.slice(a, 512)
                ids, offsets, same = [], [0], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    packed = encoder.encode(text or "")
                    ids.append(packed)
                    offsets.append(offsets[-1] + len(packed) // 4)
                    same.append(None if text is None else encoder.decode(memoryview(packed).cast("i")) == text)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(np.diff(offsets), pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row of ``docs``, in one narrow pass.

    ``ids`` is the segmentation of the whole text with the best total score under the pieces of ``model``,
    with the usual space mark before the text; characters that no piece has become bytes. ``round_trip``
    tells whether decoding gives the text back, which it does unless the text has a space mark of its own.
    Null and empty texts have no ids, and a null has a null ``round_trip``. Repeated rows and null
    ``doc_id`` give their own rows. Of paths of equal score the one whose last piece is longest is taken, and
    so on back. Texts are encoded whole, however long. Other columns aren't read. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(shared), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``.

    Null ids give a null text, no ids an empty one. Repeated rows and null ``doc_id`` give their own rows.
    Other columns aren't read. No rows give no rows.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            texts = [None if ids is None else decoder(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
