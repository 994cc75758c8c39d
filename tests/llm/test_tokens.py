import random

import numpy as np
import pytest
from graphloom.llm import sentencepieces as P
from graphloom.llm import tokenfile as T
from hypothesis import given, settings
from hypothesis import strategies as st

VOCABULARY = P.Vocabulary.read()
ENCODER = P.Encoder(VOCABULARY)
RANKS = T.read_ranks()
CODER = T.BytePairs(RANKS, T.id_type(RANKS))


def brute(text):
    """The best score over the whole text, by trying all pieces at all places."""
    score = {VOCABULARY.pieces[i]: VOCABULARY.scores[i] for i in VOCABULARY.normal}
    longest = max(map(len, score))
    s = P.SPACE + text.replace(" ", P.SPACE)
    best = [0.0] + [-1e300] * len(s)
    for end in range(1, len(s) + 1):
        best[end] = best[end - 1] + ENCODER.worst
        for start in range(max(0, end - longest), end):
            if s[start:end] in score:
                best[end] = max(best[end], best[start] + score[s[start:end]])
    return best[-1]


def score_of(text):
    s, total, at = P.SPACE + text.replace(" ", P.SPACE), 0.0, 0
    ids = np.frombuffer(ENCODER.encode(text), np.int32).tolist()
    while ids:
        i = ids.pop(0)
        if i in VOCABULARY.bytes_.values():
            n = len(s[at].encode())
            assert [i, *ids[: n - 1]] == [VOCABULARY.bytes_[b] for b in s[at].encode()]
            ids = ids[n - 1 :]
            total, at = total + ENCODER.worst, at + 1
        else:
            piece = VOCABULARY.pieces[i]
            assert s.startswith(piece, at)
            total, at = total + VOCABULARY.scores[i], at + len(piece)
    assert at == len(s)
    return total


TEXTS = ["the cat", "  two  spaces ", "a\nb\n\nc", "漢字☃\u0000", "Thnterononshth, erinher", " ", "x" * 300, "näive \U0001f600!", "\ttab\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_viterbi_is_optimal(text):
    assert score_of(text) == pytest.approx(brute(text))
    assert ENCODER.decode(np.frombuffer(ENCODER.encode(text), np.int32)) == text


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters=P.SPACE, exclude_categories=["Cs"]), max_size=60))
def test_round_trip(text):
    ids = np.frombuffer(ENCODER.encode(text), np.int32)
    assert ENCODER.decode(ids) == text
    if text:
        assert score_of(text) == pytest.approx(brute(text))


def test_at_least_as_good_as_the_library_with_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as M

    m = M.ModelProto()
    m.ParseFromString(open(P.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    rng, same = random.Random(0), 0
    for _ in range(200):
        text = " ".join("".join(rng.choices(["th", "er", "on", "and", "q", "é", "ch", "tion"], k=rng.randint(1, 5))) for _ in range(6))
        ours, theirs = np.frombuffer(ENCODER.encode(text), np.int32).tolist(), sp.encode(text)
        total = lambda ids: sum(VOCABULARY.scores[i] for i in ids)
        assert total(ours) >= total(theirs)
        same += ours == theirs
    assert same >= 150


def test_encode_and_decode(spark, edge_docs, no_docs):
    rows = {(r.doc_id, r.n_tokens): r for r in P.encode(edge_docs).collect()}
    assert P.encode(edge_docs).count() == edge_docs.count()
    assert rows[2, 0].round_trip is None and rows[3, 0].round_trip is True
    assert all(r.round_trip is not False and len(r.ids) == r.n_tokens for r in rows.values())
    texts = {r.doc_id: r.text or "" for r in edge_docs.filter("doc_id > 1").collect()}
    assert {r.doc_id: r.text for r in P.decode(P.encode(edge_docs)).filter("doc_id > 1").collect()} == texts
    assert P.encode(no_docs).collect() == []
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert P.encode(marked).first().round_trip is False


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_segments_give_the_same_ids(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert np.frombuffer(CODER.encode(text), CODER.dtype).tolist() == CODER.encoding.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(lengths):
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    ef = T.EliasFano.encode(offsets)
    assert ef.decode().tolist() == offsets.tolist()
    for i in {0, len(offsets) // 2, len(offsets) - 1}:
        assert ef.select(i) == offsets[i]
    bits = 8 * (len(ef.low) + len(ef.high))
    assert bits <= len(offsets) * (3 + np.log2(offsets[-1] / len(offsets) + 2)) + 16


def test_long_segments_are_not_kept():
    rng = random.Random(4)
    encoder, coder = P.Encoder(VOCABULARY), T.BytePairs(RANKS, T.id_type(RANKS))
    for n in (60, 20_000):
        text = "".join(rng.choices("abcdefgh漢字", k=n))
        assert encoder.decode(np.frombuffer(encoder.encode(text), np.int32)) == text
        assert encoder.encode(text) == encoder.encode(text)
        assert coder.encoding.decode(np.frombuffer(coder.encode(text), coder.dtype).tolist()) == text
    encoder.encode("short words"), coder.encode("short words")
    for kept, most in ((encoder, P.KEPT_CHARACTERS), (coder, T.KEPT_CHARACTERS)):
        assert kept and max(map(len, kept)) <= most


def test_sparse_select():
    offsets = np.array([0] * 300 + [10**6] * 300 + [10**9])
    ef = T.EliasFano.encode(offsets)
    assert [ef.select(i) for i in range(len(offsets))] == offsets.tolist()
    with pytest.raises(IndexError):
        ef.select(len(offsets))


def test_shards(edge_docs, no_docs):
    texts = sorted((r.doc_id or -1, r.text or "") for r in edge_docs.collect())
    for size in (T.SHARD_IDS, 50):
        shards = T.write_shards(edge_docs, shard_ids=size)
        got = []
        for row in shards.collect():
            assert T.boundaries(row).select(row.n_docs) == row.n_ids
            got += [(d or -1, CODER.encoding.decode(T.document(row, i).tolist())) for i, d in enumerate(row.doc_ids)]
        assert sorted(got) == texts
        read = T.read_shards(shards).collect()
        assert sorted((r.doc_id or -1, CODER.encoding.decode(r.ids)) for r in read) == texts
    assert T.write_shards(no_docs).collect() == []
