import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import langid as L
from graphloom.llm import quality as Q
from pyspark.sql import functions as F


def test_features_match_a_regular_expression():
    texts = ["The cat, the cat!! été\tx", "", "  ", "a", "###*** b"]
    seen = {}
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        one, s1, two, s2 = Q.features(raw, np.array([0, len(raw)]), 1 << 30)
        words = re.findall(r"[0-9A-Za-z\u0080-￿]+|[^0-9A-Za-z\u0080-￿\s]+", text)
        assert len(one) == len(words) and len(two) == max(0, len(words) - 1)
        for w, b in [*zip(words, one), *zip(zip(words, words[1:]), two)]:
            assert seen.setdefault(w, b) == b
    assert len(set(seen.values())) == len(seen)


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([-(10**12), 0, 7, rng.randrange(-1000, 1000), rng.randrange(10**15)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 499, 500):
        assert Q.kth_largest(df, k) == sorted(values)[-k]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re"], k=rng.randint(1, 4)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        rows.append((i, " ".join(x + rng.choice(["***", "###", "$$$"]) for x in w) if bad else " ".join(w), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    return docs, docs.filter("doc_id % 2 = 0").select("doc_id", F.col("good").alias("quality"))


def hashed(word, seed=0):
    """The hash of a word's bytes, by whole numbers."""
    h, power = 0, 1
    for byte in word.encode():
        h = (h + (byte + 1) * power) % 2**64
        power = power * 0x9E3779B97F4A7C15 % 2**64
    return finished(h)


def finished(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def buckets_of(text):
    words = [hashed(w) for w in re.findall(r"[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u1fff]+|[^0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u1fff\s]+", text)]
    pairs = [finished((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(words, words[1:])]
    return Counter(h % Q.BUCKETS for h in words + pairs)


def fitted(x, y):
    """The logistic curve by halving intervals of both parameters, on the scaled values, with the same small ridge."""
    scale = float(np.std(x)) or 1.0
    z = np.array(x) / scale

    def zero(f, low, high):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) > 0 else (low, middle)
        return low

    off = lambda a, b: y - 1 / (1 + np.exp(-np.clip(a + b * z, -40, 40)))
    best = lambda b: zero(lambda a: off(a, b).sum(), -500.0, 500.0)
    b = zero(lambda b: (off(best(b), b) * z).sum() - 1e-2 * b, -200.0, 200.0)
    return best(b), b / scale


def brute_sample(spark, docs, labels):
    """(probability, key) by doc_id, and the doc_ids that are kept: texts are counted, scored and drawn one by one."""
    rows = [r for r in docs.select("doc_id", "text").collect() if r.text and r.text.strip()]
    marks = {}
    for r in labels.select("doc_id", "quality").collect():
        if r.doc_id is not None and r.quality is not None:
            marks[r.doc_id] = min(marks.get(r.doc_id, 1), int(r.quality >= 1))
    half = {r.doc_id: r.half for r in spark.createDataFrame([(d,) for d in marks], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(Q.SEED)), F.lit(2)).alias("half")).collect()}
    grams = {r.doc_id: buckets_of(r.text) for r in rows}
    raw = sum(grams.values(), Counter())
    target = sum((g for d, g in grams.items() if half.get(d) == 0 and marks[d] == 1), Counter())
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def mean(g):
        total = 0.0
        for b, n in g.items():
            q = (raw[b] + 1) / (n_raw + Q.BUCKETS)
            total += n * (math.log((target[b] + Q.PRIOR * n_target * q) / (n_target * (1 + Q.PRIOR))) - math.log(q))
        return total / sum(g.values())

    x = {d: mean(g) for d, g in grams.items()}
    held = [d for d in grams if half.get(d) == 1]
    a, b = fitted([x[d] for d in held], np.array([marks[d] for d in held]))
    p = {d: 1 / (1 + math.exp(-a - b * v)) for d, v in x.items()}
    u = {r.doc_id: (r.h + 0.5) / (1 << 40) for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(Q.SEED), "doc_id", "text"), F.lit(1 << 40)).alias("h")).collect()}
    key = {d: math.log(max(p[d], 1e-300)) - math.log(-math.log(u[d])) for d in p}
    return p, set(sorted(key, key=key.get)[-round(sum(p.values())) :])


def test_resampling_matches_brute_force(spark, judged):
    docs, labels = judged
    kept = {r.doc_id: r for r in Q.quality_sample(docs, labels).collect()}
    p, want = brute_sample(spark, docs, labels)
    for d, r in kept.items():
        assert r.p_good == pytest.approx(p[d], abs=1e-4)
    assert set(kept) == want


def test_resampling_of_the_table_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in Q.quality_sample(docs, labels).collect()}
    _, want = brute_sample(spark, docs, labels)
    assert len(kept ^ want) <= 0.01 * len(want)  # a sum of floats may tip the count or the last one


def test_blank_texts_are_rejected(spark):
    blank = [" ", "\n", " \n\t ", "\r\n", "\u00a0", "\u3000 \u2003", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*blank, "a word", "\u00a0a"])], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.doc_id for r in Q.resample(docs, none).collect()) == [len(blank), len(blank) + 1]
    assert sorted(r.doc_id for r in Q.quality_sample(docs, none).collect()) == [len(blank), len(blank) + 1]


def test_held_out_quality(judged):
    docs, labels = judged
    kept = {r.doc_id for r in Q.resample(docs, labels).collect()}
    rest = [r for r in docs.collect() if r.doc_id % 2]
    good = [r.doc_id in kept for r in rest if r.good]
    bad = [r.doc_id in kept for r in rest if not r.good]
    assert sum(good) / len(good) >= 0.95 and sum(bad) / len(bad) <= 0.1


def test_quality_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (6, 1), (None, 1), (6, 1), (7, 0), (8, 1)], "doc_id long, quality int")
    for marks in (none, labels):
        kept = Q.resample(edge_docs, marks)
        assert kept.columns == edge_docs.columns
        assert all(r.text and r.text.strip() for r in kept.select("text").collect())
        assert Q.resample(no_docs, marks).collect() == []
    assert {r.doc_id for r in Q.resample(edge_docs, none).filter("doc_id is not null").collect()} >= {1, 5, 6, 7, 8, 9}
    assert Q.resample(edge_docs, none).filter("text = 'the cat sat on the mat and looked at the dog'").count() == 3


def ppm(trees_grams, order, least, lang, context, symbol, alphabet):
    """-log2 of a symbol's probability by escapes from the longest kept context, one context at a time."""
    counts, kept = trees_grams
    bits, out = 0.0, set()
    for d in range(min(order, len(context)), -1, -1):
        c = context[len(context) - d :]
        if d and c not in kept:
            continue
        seen = {s: n for s, n in counts[lang].get(c, {}).items() if s not in out}
        if not seen:
            continue
        n, u = sum(seen.values()), len(seen)
        if symbol in seen:
            return bits + math.log2(n + u) - math.log2(seen[symbol])
        bits += math.log2(n + u) - math.log2(u)
        out |= set(seen)
    return bits + math.log2(256 - len(out))


def _grams(texts, order):
    c = Counter()
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            code = 0
            for j in range(order, -1, -1):
                code = code * 257 + (b[i - j] if i >= j else 256)
            c[code] += 1
    return np.array(list(c)), np.array(list(c.values()))


def test_code_lengths_match_brute_force():
    order, least = 3, 2
    samples = {"en": ["the cat sat on the mat", "that hat that the rat ate"], "de": ["die katze saß auf der matte", "der hut den die ratte aß"]}
    trees = L.build({k: _grams(v, order) for k, v in samples.items()}, order, least)
    counts = {k: {} for k in samples}
    for k, texts in samples.items():
        for t in texts:
            b = t.encode()
            for i in range(len(b)):
                for d in range(min(order, i) + 1):
                    counts[k].setdefault(b[i - d : i], Counter())[b[i]] += 1
    kept = {c for k in samples for c, n in counts[k].items() if sum(n.values()) >= least}
    for text in ["the hat", "die ratte", "xyz\u0000", "ß", "tatthe matt"]:
        got = L.code_lengths(trees, pa.array([text]))[0]
        b = text.encode()
        for k, lang in enumerate(trees.languages):
            want = sum(ppm((counts, kept), order, least, lang, b[max(0, i - order) : i], b[i], None) for i in range(len(b)))
            assert got[k] == pytest.approx(want, rel=1e-4)
    # each context's code is complete
    seen = trees.symbol
    total = (2.0 ** -trees.bits[:, seen, :].astype(float)).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def brute_trees(samples, order, share):
    """(counts by language and context, contexts that are kept), one byte at a time."""
    counts = {k: {} for k in samples}
    for k, texts in samples.items():
        for t in texts:
            b = t.encode()
            for i in range(len(b)):
                for d in range(min(order, i) + 1):
                    counts[k].setdefault(b[i - d : i], Counter())[b[i]] += 1
    size = {k: sum(len(t.encode()) for t in texts) for k, texts in samples.items()}
    often = {c for k in samples for c, n in counts[k].items() if sum(n.values()) >= share * size[k]}
    return counts, {c for c in often if all(c[i:] in often for i in range(1, len(c)))}


SMALL = {
    "en": [f"the {a} and the {b} of a house" for a in ("cat", "rat") for b in ("dog", "hat", "king", "tree", "sea", "bird")],
    "de": [f"der {a} und die {b} von einem haus" for a in ("hund", "hut") for b in ("katze", "see", "welt", "zeit", "luft", "nacht")],
}


@pytest.mark.parametrize("share", [L.LEAST_SHARE, 0.01])
def test_code_lengths_of_a_small_sample_at_the_default_order(share):
    trees = L.build({k: _grams(v, L.ORDER) for k, v in SMALL.items()}, least_share=share)
    brute = brute_trees(SMALL, L.ORDER, share)
    for text in ["the sea and the king", "der see von luft", "zzz", "é"]:
        b = text.encode()
        got = L.code_lengths(trees, pa.array([text]))[0]
        for k, lang in enumerate(trees.languages):
            want = sum(ppm(brute, L.ORDER, None, lang, b[max(0, i - L.ORDER) : i], b[i], None) for i in range(len(b)))
            assert got[k] == pytest.approx(want, rel=1e-4)
    assert len(trees.step) == len(brute[1] | {b""})


def test_a_small_sample_tells_languages(spark):
    rows = [(i, t, k) for k, texts in SMALL.items() for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = spark.createDataFrame([(1, "the hat and the sea"), (2, "die welt und der hund"), (3, "the king of a tree"), (4, "zeit und nacht")], "doc_id long, text string")
    assert {r.doc_id: r.language for r in L.identify(other, docs).collect()} == {1: "en", 2: "de", 3: "en", 4: "de"}


def test_counts_in_spark_match(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "the hat", "en"), (3, "", "en")], "doc_id long, text string, lang string")
    rows = docs.select("lang", "text").mapInArrow(L._count(4), "lang string, gram long, n long").collect()
    want = dict(zip(*map(np.ndarray.tolist, _grams(["the cat", "the hat"], 4))))
    got = Counter()
    for r in rows:
        got[r.gram] += r.n
    assert got == want


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and length(text) >= 40")
    rows = L.identify(test, train).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) / len(rows) >= 0.98


def test_language_edges(edge_docs, no_docs):
    rows = L.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.language is None for r in rows if r.doc_id in (2, 3))
    kept = L.accepted(edge_docs)
    assert kept.columns == edge_docs.columns and kept.filter("text is null or text = ''").count() == 0
    assert kept.filter("doc_id = 5").count() == 1
    assert L.identify(no_docs).collect() == [] and L.accepted(no_docs).collect() == []
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.identify(unlabelled).filter("language is not null").count() == 0
