import random
import re

import duckdb
import numpy as np
import pytest
from graphloom.llm import chat, embed_dedup, mixing, omh, urlfilter
from graphloom.llm.components import forest
from graphloom.llm.textbuf import WORDS_ONLY, mix, tokens
from pyspark.sql import functions as F

M = 2**64 - 1


# -- Order MinHash


def h64(x):
    return int(mix(np.array([x & M], np.uint64))[0])


def brute_sketch(text, k, size, sketches, seed):
    step = int(omh._STEP)
    hashes = [int(tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), WORDS_ONLY)[0][0]) for w in re.findall(r"[0-9a-z\u0080-￿]+", text.lower())]
    if not hashes:
        return 0, None
    grams = []
    for i in range(max(1, len(hashes) - k + 1)):
        acc = 0
        for j, h in enumerate(hashes[i : i + k]):
            acc = h64(acc * step + h + j + 1)
        grams.append(acc)
    count, elements = {}, []
    for g in grams:
        elements.append(h64(g * step + count.get(g, 0)))
        count[g] = count.get(g, 0) + 1
    out = []
    for j in range(1, sketches + 1):
        s = h64(j * step + seed)
        first = sorted(sorted(range(len(grams)), key=lambda i: h64(elements[i] ^ s))[:size])
        acc = s
        for i in first:
            acc = h64(acc * step + grams[i])
        out.append(acc - 2**64 if acc >= 2**63 else acc)
    return len(grams), out


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(6)
    texts = ["", "one", "one two", "a a a a a a", "été à la plage"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_kmers, r.signature) for r in omh.fingerprints(df, 3, 2, 8, 1).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_sketch(t, 3, 2, 8, 1), t


def test_fingerprints_tell_order(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    edited, moved = list(words), words[200:] + words[:200]
    for _ in range(6):
        edited[rng.randrange(400)] = "new"
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join(moved)), (3, " ".join(rng.sample(words, 400)))], "doc_id long, text string")
    s = {r.doc_id: np.array(r.signature) for r in omh.fingerprints(df, sketches=256).collect()}
    same = lambda i: (s[0] == s[i]).mean()
    assert same(1) > same(2) > same(3) and same(1) > 0.8 and same(2) < 0.7


def test_fingerprint_edges(edge_docs, no_docs):
    rows = omh.fingerprints(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all((r.signature is None) == (r.n_kmers == 0) for r in rows)
    assert [r.signature is None for r in rows if r.doc_id in (2, 3, 4, 9)] == [True] * 4
    assert omh.fingerprints(no_docs).collect() == []


# -- mixing


def test_mixing_matches_sql_and_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(c.execute(f"select doc_id, source, copy from ({mixing.sql()})").fetchall())
    mixed = mixing.mix(docs, copy="copy")
    assert sorted(tuple(r) for r in mixed.select("doc_id", "source", "copy").collect()) == want
    count = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.n_tokens(F.col("text"))).alias("n")).collect()}
    per, after = count(docs), count(mixed)
    goal = sum(per.values()) / len(per)
    assert all(abs(after[s] / goal - 1) < 0.5 for s in per)
    assert abs(sum(after.values()) / sum(per.values()) - 1) < 0.1


def test_mixing_weights(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 10 else "y" if i < 20 else None) for i in range(30)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.rates(docs, {"x": 3.0, "z": 1.0}, 160.0).collect()}
    assert rates == {"x": pytest.approx(4.0 * 3 / 3), "y": 0.0}
    rows = mixing.mix(docs, {"x": 3.0}, 100.0, copy="n").collect()
    per = {i: sorted(r.n for r in rows if r.doc_id == i) for i in range(10)}
    assert {r.source for r in rows} == {"x"} and all(p in ([0, 1], [0, 1, 2]) for p in per.values())
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_mixing_edges(edge_docs, no_docs):
    out = mixing.mix(edge_docs, total=1e6)
    assert out.columns == edge_docs.columns and out.filter("source is null").count() == 0
    counts = {(r.doc_id, r.text): r["count"] for r in out.filter("doc_id = 1").groupBy("doc_id", "text").count().collect()}
    assert all(n % 2 == 0 for n in counts.values())  # the repeated rows are drawn together
    assert mixing.mix(no_docs).collect() == [] and mixing.mix(edge_docs, {}).collect() == []


# -- URL filter


CANONICAL = {
    "http://www.Example.com/a/": "example.com/a", "HTTPS://example.com:443/a#top": "example.com/a", "https://example.com/A?utm_source=x&b=1": "example.com/A?b=1",
    "http://example.com/?ref=x": "example.com", "https://example.com/index.html": "example.com", "example.com/a?b=1&utm_medium=q": "example.com/a?b=1", "": "", "http://example.com:8080/": "example.com:8080", "http://example.com/index.htm?a=1": "example.com?a=1", "https://example.com/?a=1": "example.com?a=1",
}


def test_canonical(spark):
    df = spark.createDataFrame([(k,) for k in CANONICAL], "url string")
    assert {r.url: r.c for r in df.select("url", urlfilter.canonical(F.col("url")).alias("c")).collect()} == CANONICAL
    c = duckdb.connect()
    for url, want in CANONICAL.items():
        assert c.execute(f"select {urlfilter.canonical_sql('?')}".replace("?,", "$u,").replace("trim(?", "trim($u"), {"u": url}).fetchone()[0] == want


def test_filter_has_no_false_answers(spark):
    pages = spark.createDataFrame([(i, f"https://www.h{i % 50}.org/p{i}?utm_a=1") for i in range(2000)], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://h{i % 50}.org/p{i}/",) for i in range(0, 2000, 7)] + [(None,)], "bad string")
    assert {r.page_id for r in urlfilter.unlisted(pages, listed).collect()} == {i for i in range(2000) if i % 7}
    # one overfull block lets far more pass than are listed, and the join sends them back
    urlfilter.PER_BLOCK, old = 10**6, urlfilter.PER_BLOCK
    try:
        assert urlfilter.unlisted(pages, listed).count() == sum(1 for i in range(2000) if i % 7)
    finally:
        urlfilter.PER_BLOCK = old


def test_filter_passes_few_false_hits(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("url"))
    other = spark.range(20000).select(F.concat(F.lit("q/"), "id").alias("url"))
    blocks = 5000 // urlfilter.PER_BLOCK
    bits = urlfilter.bloom(keys, blocks)

    def hits(df):
        p = df.withColumn("block", urlfilter._block(F.col("url"), blocks)).join(bits, "block")
        ok = F.lit(True)
        for k, m in enumerate(urlfilter._masks(F.col("url"))):
            ok = ok & (F.col(f"m{k}").bitwiseAND(m) == m)
        return p.filter(ok).count()

    assert hits(keys) == 5000 and hits(other) < 400


def test_filter_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "h"), (1, "http://a.b/x", "h"), (None, None, None), (2, "", None), (3, "http://a.b/" + "y" * 100_000, "h")], "page_id long, url string, block string").withColumn("m0", F.lit(1)).withColumn("with.dot", F.lit(2))
    listed = spark.createDataFrame([("https://www.a.b/x/",), (None,)], "url string")
    kept = urlfilter.unlisted(pages, listed)
    assert kept.columns == pages.columns and sorted((r.page_id or 0) for r in kept.collect()) == [0, 2, 3]
    assert urlfilter.unlisted(pages, listed.filter("false")).count() == 5
    dotted = listed.select(F.col("url").alias("the.url"), F.lit(1).alias("url"))
    assert urlfilter.unlisted(pages, dotted).count() == 3
    assert urlfilter.unlisted(pages.filter("false"), listed).collect() == []


# -- chat


def brute_pair(c, r):
    order = lambda x: sorted(x, key=lambda t: (t[0], t[1] or "", t[2] or ""))
    c, r = order(c), order(r)
    n = 0
    while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
        n += 1
    show = lambda t: f"{chat.OPEN}{t[1] or ''}\n{t[2] or ''}{chat.CLOSE}"

    def completion(turns):
        text, spans = "", []
        for t in turns:
            if t[1] == "assistant":
                spans.append(f"{len(text) + len(chat.OPEN) + len(t[1]) + 1}-{len(text) + len(show(t)) - 1}")
            text += show(t)
        return text, ",".join(spans)

    return (n, "".join(map(show, c[:n])), *completion(c[n:]), *completion(r[n:]))


def test_pairs_match_brute_force(spark):
    rng = random.Random(11)
    sides = {"c": [], "r": []}
    for i in range(60):
        turns = [(j, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "bb", "été", "", "x\ny"])) for j in range(rng.randint(0, 6))]
        keep = rng.randint(0, len(turns))
        other = turns[:keep] + [(keep + j, rng.choice(["user", "assistant"]), rng.choice(["a", "zz"])) for j in range(rng.randint(0, 3))]
        sides["c"] += [(i, *t) for t in turns]
        sides["r"] += [(i, *t) for t in other]
    frame = lambda k: spark.createDataFrame(sides[k], "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in chat.preference_pairs(frame("c"), frame("r")).collect()}
    ids = {x[0] for k in sides for x in sides[k]}
    assert set(got) == ids
    for i in ids:
        assert got[i] == brute_pair(*([x[1:] for x in sides[k] if x[0] == i] for k in "cr"))
        _, _, text, spans, *_ = got[i]
        for span in filter(None, spans.split(",")):
            a, b = map(int, span.split("-"))
            assert text[a:b].endswith("<|im_end|>") and text[:a].endswith("assistant\n")


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, side string"
    c = spark.createDataFrame([(1, 0, None, None, "z"), (1, 0, None, None, "z"), (None, 0, "user", "x", "z"), (2, None, "assistant", "y" * 50_000, None)], schema)
    rows = {r.conv_id: r for r in chat.preference_pairs(c, c.filter("false")).collect()}
    assert set(rows) == {1, 2} and rows[1].prompt == "" and rows[2].rejected == ""
    same = chat.preference_pairs(c, c).filter("conv_id = 1").first()
    assert (same.prompt_turns, same.chosen, same.rejected, same.chosen_mask) == (2, "", "", "")
    assert chat.preference_pairs(c.filter("false"), c.filter("false")).collect() == []


def test_all_answered_conversations_make_pairs(spark):
    talks = {
        1: [("user", "a"), ("assistant", "b")], 2: [("user", "c")], 4: [("assistant", "d"), ("user", "e"), (None, "x")],
        7: [("user", "f"), ("assistant", "g"), ("user", "h"), ("assistant", None), ("user", "i")], 9: [("system", "s"), ("assistant", "j")], 12: [("user", "k")],
    }
    frame = lambda some: spark.createDataFrame([(i, j, *t) for i in some for j, t in enumerate(talks[i])] + [(None, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: tuple(r)[1:] for r in chat.format_pairs(chat.made_pairs(frame(talks))).collect()}
    answered = [1, 4, 7, 9]
    assert sorted(rows) == answered
    last = {i: max(j for j, t in enumerate(talks[i]) if t[0] == "assistant") for i in answered}
    for i, k in zip(answered, answered[1:] + answered[:1]):
        c = [(j, *t) for j, t in enumerate(talks[i])]
        r = c[: last[i]] + [(last[i], "assistant", talks[k][last[k]][1])] + c[last[i] + 1 :]
        assert rows[i] == brute_pair(c, r)
    sole = chat.format_pairs(chat.made_pairs(frame([2, 9]))).collect()
    assert [(r.conv_id, r.chosen_mask != "", r.rejected) for r in sole] == [(9, True, "")]
    assert chat.made_pairs(frame([2])).collect() == []


def test_made_pairs_match_sql(spark):
    c = duckdb.connect()
    c.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = c.execute(chat.sql())
    names = [d[0] for d in want.description]
    rows = chat.format_pairs(chat.made_pairs(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    assert sorted(names) == sorted(rows.columns)
    assert sorted(tuple(r) for r in rows.select(*names).collect()) == sorted(want.fetchall())


def test_all_pairs_of_the_table(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = talks.filter("role = 'assistant'").select("conv_id").distinct().count()
    rows = chat.format_pairs(chat.made_pairs(talks)).collect()
    assert len(rows) == want
    assert all(r.chosen_mask and r.rejected_mask or r.chosen == r.rejected == "" for r in rows)


# -- embeddings


def test_embedding_recall(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((3000, 64)))
    near = unit(base[:300] + rng.uniform(0.1, 0.34, (300, 1)) * unit(rng.standard_normal((300, 64))))
    crowd = unit(base[7] + 0.05 * unit(rng.standard_normal((400, 64))))  # far more than a window
    x = np.concatenate([base, near, crowd, np.repeat(base[9:10], 300, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    group = {r.vec_id: r.group_id for r in embed_dedup.duplicates(df).collect()}
    cos = x @ x.T
    pairs = np.argwhere(np.triu(cos >= embed_dedup.THRESHOLD + 1e-6, 1))
    assert len(group) == len(x)
    assert np.mean([group[a] == group[b] for a, b in pairs]) >= 0.99
    single = [(a, b) for a, b in pairs if a < 300 and b - 3000 == a]
    assert len(single) > 200 and np.mean([group[a] == group[b] for a, b in single]) >= 0.9
    lone = [i for i in range(3000) if (cos[i] >= embed_dedup.THRESHOLD - 1e-6).sum() == 1]
    assert len(lone) > 2000 and all(group[i] == i for i in lone)


@pytest.mark.parametrize("compared", [embed_dedup.COMPARED, 500])
def test_pairs_in_a_dense_region(spark, compared):
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    parts = []
    for cosine in (0.9, 0.85):  # of any two in the region
        center = unit(rng.standard_normal(64))
        region = unit(cosine**0.5 * center + (1 - cosine) ** 0.5 * unit(rng.standard_normal((4000, 64))))
        away = rng.standard_normal((300, 64))
        away = unit(away - (away * region[:300]).sum(axis=1, keepdims=True) * region[:300])
        parts += [region, 0.952 * region[:300] + (1 - 0.952**2) ** 0.5 * away]
    x = np.concatenate([*parts, unit(rng.standard_normal((3000, 64)))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<float>")
    got = {(r.u, r.v) for r in embed_dedup.near_pairs(df, 64, len(x), embed_dedup.THRESHOLD, embed_dedup.WINDOW, embed_dedup.RECALL, embed_dedup.SEED, compared).collect()}
    assert all(x[a] @ x[b] >= embed_dedup.THRESHOLD - 1e-6 for a, b in got)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for start in (0, 4300):
        assert np.mean([find(start + i) == find(start + 4000 + i) for i in range(300)]) >= 0.95


def test_depths_and_joining_pairs_match_brute_force():
    rng = np.random.default_rng(22)
    bits, window = embed_dedup.KEY_BITS, 8
    key = np.sort(np.concatenate([rng.integers(0, 2**bits, 300), rng.integers(0, 2**30, 60), np.full(12, 5), rng.integers(0, 2**bits, 5) + (1 << bits), rng.integers(0, 2**bits, 50) + (2 << bits)]))
    got = embed_dedup.depths(key, window)
    run = lambda i, d: (key >> (bits - d) == key[i] >> (bits - d)).sum()
    assert got.tolist() == [next((d for d in range(bits + 1) if run(i, d) <= window), bits + 1) for i in range(len(key))]
    assert embed_dedup.depths(key[:8], window).tolist() == [0] * 8
    x = rng.standard_normal((60, 2)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.arange(0, 30), np.arange(30, 60)
    label = lambda pairs: _labels(60, pairs)
    for first, second in ((a, b), (a, a)):
        u, v = embed_dedup.joining(x, first, second, 0.9)
        every = [(i, j) for i in first for j in second if i != j and x[i] @ x[j] >= 0.9]
        assert set(zip(u, v)) <= set(every) and len(u) < len(every) and label(zip(u, v)) == label(every)


def test_forests_join_what_edges_join():
    rng = np.random.default_rng(31)
    for n, m in ((2, 3), (60, 25), (60, 300), (400, 390)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = forest(u, v)
        assert _labels(n, zip(u[kept], v[kept])) == _labels(n, zip(u, v))
        assert len(kept) == n - len(set(_labels(n, zip(u, v))))


def test_codes_bound_products():
    rng = np.random.default_rng(32)
    x = rng.standard_normal((200, 24)).astype(np.float32)
    x[0, :] = 0
    x[0, 3] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, error = embed_dedup.decoded(embed_dedup.coded(x))
    assert (np.abs(y @ y.T - x @ x.T) <= error[:, None] + error + error[:, None] * error + 1e-6).all() and error.max() < 0.02


def test_borders_reach_over_short_partitions():
    rng = random.Random(33)
    for _ in range(30):
        sizes = [(2 * i + 1, rng.choice([1, 1, 2, 3, 9])) for i in range(rng.randint(1, 9))]
        window = rng.randint(1, 6)
        rows = [(p, r) for p, n in sizes for r in range(n)]
        start = {p: rows.index((p, 0)) for p, _ in sizes}
        want = {(to, j - start[to]): rows[j] for to, _ in sizes[1:] for j in range(max(0, start[to] - window), start[to])}
        count = dict(sizes)
        got = {(to, -1 - after - w): (n, count[n] - 1 - w) for n, to, take, after in embed_dedup.borders(sizes, window) for w in range(take)}
        assert got == want


def test_pairs_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(34)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((400, 32)))
    away = rng.standard_normal((400, 32))
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, 0.96 * base + (1 - 0.96**2) ** 0.5 * away]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<float>")
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"]
    old, seen = [spark.conf.get(c) for c in names], []
    try:
        for setting in (("4", "true"), ("4", "false"), ("100", "true"), ("100", "false"), ("200", "false")):
            for c, value in zip(names, setting):
                spark.conf.set(c, value)
            seen.append({(r.u, r.v) for r in embed_dedup.near_pairs(df, 32, 800, embed_dedup.THRESHOLD, 16, 0.9, 3).collect()})
    finally:
        for c, value in zip(names, old):
            spark.conf.set(c, value)
    assert all(s == seen[0] for s in seen)
    assert sum((i, 400 + i) in seen[0] for i in range(400)) >= 360
    assert all(x[a] @ x[b] >= embed_dedup.THRESHOLD - 1e-6 for a, b in seen[0])


def _labels(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        of = [of[a] if g == of[b] else g for g in of]
    return [of.index(g) for g in of]


def test_passes_grow_with_the_table():
    n = [embed_dedup.passes_for(k) for k in (2, 1000, 10**5, 10**8)]
    assert n == sorted(n) and n[0] == 1 and n[-1] < 100


def test_embedding_edges(spark):
    v = [1.0] + [0.0] * 3
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0] * 4), (6, [float("nan")] * 4), (7, [1.0, None, 0.0, 0.0]), (8, [1.0] * 9), (None, v), (9, [2.0, 0.0, 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("pass", F.lit(1))
    got = {r.vec_id: (r.group_id, r.n_copies) for r in embed_dedup.duplicates(df).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 9: (1, 3), **{i: (i, 1) for i in (3, 4, 5, 6, 7, 8, 10)}}
    assert embed_dedup.duplicates(df.filter("false")).collect() == []
    assert embed_dedup.duplicates(df.filter("vec_id in (3, 4)")).count() == 2
