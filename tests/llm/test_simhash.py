import random
import re

import numpy as np
import pyarrow as pa
from graphloom.llm import simhash_dedup as S
from graphloom.llm.components import components
from graphloom.llm.textbuf import mix, tokens, WORDS_ONLY


def brute_signature(text):
    total, weight = np.zeros(S.BITS), 0.0
    counts = {}
    for w in re.findall(r"[0-9a-zà-öø-þßĀ-￿]+", text.lower()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        h = tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), WORDS_ONLY)[0] >> np.uint64(20)
        bits = np.unpackbits(np.stack([mix(h + s) for s in S._SEEDS], axis=1).view(np.uint8))
        total += np.sqrt(n) * bits
        weight += np.sqrt(n)
    return 2 * total.astype(np.float32) >= np.float32(weight)


def test_signatures_match_brute_force():
    rng = random.Random(1)
    words = ["the", "of", "Éa", "thing", "zoo", "A", "été", "x1"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) + "." for _ in range(60)]
    got, has = S.signatures(pa.array(texts))
    assert has.all()
    bits = np.unpackbits(got.view(np.uint8), axis=1)
    for row, t in zip(bits, texts):
        assert (row != brute_signature(t)).sum() <= 1  # a sum of floats may tip a bit that is on the edge


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (150, S.BITS), dtype=np.uint8)
    rows = [base]
    for flips in (1, 3, 8, 15, 20, 28, 32, 34):
        copy = base[:30].copy()
        for r in copy:
            r[rng.choice(S.BITS, flips, replace=False)] ^= 1
        rows.append(copy)
    bits = np.unique(np.concatenate(rows), axis=0)
    words = np.packbits(bits, axis=1).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "node long, " + ", ".join(f"{w} long" for w in S.WORDS))
    got = {tuple(r) for r in S.near_pairs(df).collect()}
    apart = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    want = {(i, j): apart[i, j] for i in range(len(bits)) for j in range(i + 1, len(bits)) if apart[i, j] <= S.MAX_DISTANCE}
    assert got <= set(want)
    assert all(p in got for p, d in want.items() if d <= S.CERTAIN)
    near = [p for p, d in want.items() if d <= 24]
    assert sum(p in got for p in near) / len(near) >= 0.9


def test_recall_up_to_the_limit(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (300, S.BITS), dtype=np.uint8)
    far = np.repeat(np.arange(24, S.MAX_DISTANCE + 1), 34)[:300]
    copies = base.copy()
    for r, flips in zip(copies, far):
        r[rng.choice(S.BITS, flips, replace=False)] ^= 1
    words = np.packbits(np.concatenate([base, copies]), axis=1).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "node long, " + ", ".join(f"{w} long" for w in S.WORDS))
    got = [tuple(r) for r in S.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    for d in (24, 28, S.MAX_DISTANCE):
        want = [(i, 300 + i) for i in np.flatnonzero(far >= d)]
        assert sum(p in got for p in want) / len(want) >= 0.95


def test_codes_that_meet_match_brute_force(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 7)
    rng = np.random.default_rng(6)
    code = np.sort((rng.integers(0, 4, 200) << (2 * S.HALF_BITS)) | (rng.integers(0, 3, 200) << S.HALF_BITS) | rng.integers(0, 32, 200))
    got = [(int(a), int(b)) for i, j in S.together(code) for a, b in zip(i, j)]
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if (x := int(code[a] ^ code[b])) < 32 and x.bit_count() <= 1 and (x or (code[a] >> 2 * S.HALF_BITS) % 2 == 0)}
    assert len(got) == len(set(got)) and set(got) == want


def test_segments_grow_with_the_signatures():
    apart = np.zeros(S.BITS + 1, np.int64)
    apart[[70, 90, 100, 128]] = 5, 900, 2000, 7000
    plans = [S.planned(n, apart) for n in (10, 10**5, 10**6, 10**7, 10**9, 10**10)]
    segments = [p[0] for p in plans]
    assert segments == sorted(segments, reverse=True) and segments[0] == S.SEGMENTS > segments[-1]
    assert all(1 - S.missed(s, S.MAX_DISTANCE) ** c >= S.RECALL for s, c in plans)
    assert 2 * max(s * c for s, c in plans) < 1 << 62 - 2 * S.HALF_BITS and S.BITS // segments[-1] <= 2 * S.HALF_BITS
    assert S.missed(17, 32) == 0 and S.missed(4, 9) > 0


def test_chances_match_a_simulation():
    rng = np.random.default_rng(8)
    for segments in (12, 8, 6):
        length = S.BITS // segments
        miss = 0
        for _ in range(4000):
            flips = np.bincount(rng.choice(S.BITS, 32, replace=False) // length, minlength=segments + 1)[:segments]
            miss += (flips > 1).all()
        assert abs(miss / 4000 - S.missed(segments, 32)) < 0.03


def test_recall_of_other_segments(spark):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2, (400, S.BITS), dtype=np.uint8)
    copies = base.copy()
    for r in copies:
        r[rng.choice(S.BITS, S.MAX_DISTANCE, replace=False)] ^= 1
    words = np.packbits(np.concatenate([base, copies]), axis=1).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "node long, " + ", ".join(f"{w} long" for w in S.WORDS))
    for segments in (10, 8):
        got = {tuple(r) for r in S.near_pairs(df, S.MAX_DISTANCE, segments, S.cuts_for(segments)).collect()}
        assert np.mean([(i, 400 + i) in got for i in range(400)]) >= 0.93


def test_links_join_what_pairs_join():
    rng = np.random.default_rng(2)
    for n, m in ((2, 1), (50, 30), (50, 200), (300, 280)):
        u, v = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        root, node = S.linked(u, v)
        of = {x: x for x in {*u.tolist(), *v.tolist()}}
        for a, b in zip(u.tolist(), v.tolist()):
            low, high = sorted((of[a], of[b]))
            of = {x: low if y == high else y for x, y in of.items()}
        assert dict(zip(node.tolist(), root.tolist())) == {x: y for x, y in of.items() if x != y}


def brute_groups(texts):
    """duplicate_of for each of some documents by their numbers, from all pairs of signatures."""
    of = {d: brute_signature(t) for d, t in texts.items()}
    root = {d: d for d in of}
    ids = sorted(of)
    bits = np.stack([of[d] for d in ids])
    for i, j in np.argwhere((bits[:, None] != bits[None]).sum(axis=2) <= S.MAX_DISTANCE):
        a, b = sorted((root[ids[i]], root[ids[j]]))
        root = {d: a if r == b else r for d, r in root.items()} if a != b else root
    return {d: r for d, r in root.items() if d != r}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_groups({d: t for d, t in texts.items() if re.search(r"[0-9a-zA-ZÀ-ɏ]", t)})
    got = {r.doc_id: r.duplicate_of for r in S.duplicates(docs).collect()}
    assert len(want) > 5 and len(set(got.items()) ^ set(want.items())) <= 0.05 * len(want)


def test_unspaced_scripts_and_case(spark):
    rng = random.Random(12)
    chinese = lambda n: [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)]
    one, two = chinese(2000), chinese(2000)
    near, spaced = list(one), "".join(one[:1000]) + "\u3000" + "".join(one[1000:])
    near[700] = "新"
    russian = " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(100))
    texts = ["".join(one), "".join(near), "".join(two), spaced, russian, russian.upper(), russian.replace(" ", "\u00a0"), "!!! ???", "!!! ???", "!!! ??", "", " \u3000\u00a0\n", "\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.duplicate_of for r in S.duplicates(df).collect()} == {1: 0, 3: 0, 5: 4, 6: 4, 8: 7}
    got, _ = S.signatures(pa.array(texts[:2]))
    assert np.bitwise_count((got[0] ^ got[1]).view(np.uint64)).sum() < 8


def test_components_match_union_find(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (30, 12), (200, 150), (60, 59)):
        edges = [(i, i + 1) for i in range(m)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        linked = {x for a, b in edges for x in (a, b) if a != b}
        assert got == {x: find(x) for x in linked}


def test_groups(spark):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(200)]
    clean = [text() for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(clean)]
    for k in range(60):  # near copies of 3, more than there are windows or caps
        t = list(clean[3])
        for _ in range(4):
            t[rng.randrange(200)] = f"n{rng.randrange(5000)}"
        rows.append((100 + k, " ".join(t)))
    rows += [(200 + k, " ".join(clean[7])) for k in range(50)]
    got = {r.doc_id: r.duplicate_of for r in S.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get(200 + k) == 7 for k in range(50))
    assert sum(got.get(100 + k) == 3 for k in range(60)) >= 58
    assert not set(got) & set(range(40))


def test_edge_cases(edge_docs, no_docs):
    assert S.duplicates(edge_docs).collect() == []
    twice = edge_docs.filter("doc_id = 1").withColumn("doc_id", edge_docs.doc_id + 50)
    assert [tuple(r) for r in S.duplicates(edge_docs.unionByName(twice)).collect()] == [(51, 1)]
    assert S.duplicates(no_docs).collect() == []
