import numpy as np
import pyarrow as pa
import pytest
from graphloom import vocab as V
from graphloom.operators import build, corpus, lineage, linking, patterns, stats, traversal, vectors
from graphloom.schema import TRIPLES
from pyspark.sql import functions as F

T = "iri", None, None
SMALL = [
    ("m1", V.TYPE, V.MEME, *T), ("m2", V.TYPE, V.MEME, *T), ("p1", V.TYPE, V.PERSON, *T), ("p1", V.TYPE, V.TAG, *T), ("t1", V.TYPE, V.TAG, *T),
    ("m1", V.MENTIONS, "p1", *T), ("m2", V.MENTIONS, "p1", *T), ("m1", V.HAS_TAG, "t1", *T), ("m1", V.HAS_TAG, "p1", *T), ("m2", "kg:self", "m2", *T), ("p1", "kg:knows", "x", *T),
    ("m1", V.LABEL, "One", "literal", V.STRING, None), ("m2", V.LABEL, "Two", "literal", V.STRING, None), ("m1", V.VIEWS, "7", "literal", V.INTEGER, None), ("m1", V.COMMENTS, "2", "literal", V.INTEGER, None),
]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame(SMALL, TRIPLES)


@pytest.fixture(scope="module")
def empty(g):
    return g.filter("false")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_structure(g, empty):
    s = stats.graph_structure(g).first()
    assert (s.triples, s.edges, s.literal_triples, s.subjects, s.literal_objects) == (15, 11, 4, 4, 4)
    assert s.nodes == len({r[0] for r in SMALL} | {r[2] for r in SMALL if r[3] == "iri"})
    e = stats.graph_structure(empty).first()
    assert (e.triples, e.nodes, e.iri_percent) == (0, 0, None)
    assert stats.density(empty).first().density_percent == 0
    assert stats.quality_scores(empty).first().overall == 0


def test_degrees(g, empty):
    d = {r.e: r.degree for r in stats.entity_degrees(g).collect()}
    assert d == {"m1": 3, "m2": 3, "p1": 4, "t1": 1, "x": 1}  # a loop counts at both of its ends
    s = stats.degree_stats(g).first()
    assert (s.entities, s.max_degree, s.min_degree, s.isolated) == (4, 4, 1, 0)
    assert stats.degree_stats(empty).first().entities == 0
    assert stats.most_connected(g, 1).first().e == "p1"


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([5], 5)):
        assert stats.distribution(spark.createDataFrame([(v,) for v in values], "n long")).first().upper_median == want


@pytest.mark.parametrize("shared, want", [(5, None), (8, False), (9, True), (10, True)])
def test_overlap(spark, shared, want):
    df = spark.createDataFrame([*((f"n{i}", V.TYPE, "A", *T) for i in range(10)), *((f"n{i}", V.TYPE, "B", *T) for i in range(10 - shared, 110)), ("q", V.TYPE, "C", *T), ("q2", V.TYPE, "C", *T)], TRIPLES)
    got = {r["sub"]: r.kept for r in stats.class_overlap(df).collect()}
    assert got == ({} if want is None else {"A": want})


def test_inference_prefers_what_is_declared(g):
    assert {r.p: r["class"] for r in stats.inferred_classes(g, "domain", 2).collect()}[V.MENTIONS] == V.MEME
    more = g.unionByName(g.limit(1).withColumns({"s": F.lit(V.MENTIONS), "p": F.lit(V.DOMAIN), "o": F.lit("Z")}))
    r = {r.p: r for r in stats.inferred_classes(more, "domain", 2).collect()}[V.MENTIONS]
    assert (r["class"], r.source) == ("Z", "explicit")


def test_patterns(g):
    assert rows(patterns.bgp(g, ("?m", V.MENTIONS, "?p"), ("?m", V.HAS_TAG, "?p"))) == [("m1", "p1")]
    assert rows(patterns.bgp(g, ("?a", "kg:self", "?a"))) == [("m2",)]
    assert {r.m: r.v for r in patterns.optional(patterns.bgp(g, ("?m", V.TYPE, V.MEME)), patterns.bgp(g, ("?m", V.VIEWS, "?v"))).collect()} == {"m1": "7", "m2": None}
    assert rows(patterns.having(patterns.subjects(g, V.TYPE), g, V.LABEL, negate=True)) == [("p1",), ("t1",)]
    assert rows(patterns.predicates(g, s="m2", o="p1")) == [(V.MENTIONS,)]
    assert rows(patterns.find_label(g, "tWo")) == [("m2", "Two")]
    assert {r.s: r.label for r in patterns.first_label(patterns.subjects(g, V.TYPE), g).collect()}["p1"] == "p1"
    c = patterns.entity_connections(g, "p1").orderBy("meme").collect()
    assert [(r.meme, r.kind, r.engagement) for r in c] == [("m1", "hasTag", 27), ("m2", "mentions", 0)]
    assert rows(patterns.cooccurrence(patterns.connections(g))) == [("p1", "t1", 1), ("t1", "p1", 1)]


def test_hops(spark, g):
    start = spark.createDataFrame([("t1",)], "e string")
    assert {r.e: r.depth for r in traversal.k_hop(g, start, 3).collect()} == {"t1": 0, "m1": 1, "p1": 2, "m2": 3}
    assert {r.e for r in traversal.k_hop(g, start, 3, max_nodes=2).collect()} == {"t1", "m1"}
    assert {r.e for r in traversal.k_hop(g, start, 3, "out").collect()} == {"t1"}
    assert {r.e for r in traversal.k_hop(g, start, 3, exclude_types=[V.PERSON]).collect()} == {"t1", "m1"}
    assert {r.e for r in traversal.k_hop(g, start, 3, min_degree=4).collect()} == {"t1"}
    assert traversal.k_hop(g, start.filter("false")).count() == 0
    chain = spark.createDataFrame([*((f"c{i}", "kg:n", f"c{(i + 1) % 5}", *T) for i in range(5)), *((f"c{i}", V.TYPE, "C", *T) for i in range(5))], TRIPLES)
    assert {r.e: r.depth for r in traversal.k_hop(chain, spark.createDataFrame([("c0",)], "e string"), 9, "out").collect()} == {f"c{i}": i for i in range(5)}


def test_registry(spark):
    a = [("x", "Tag", False, 0, 1), ("x", "Meme", True, 1, 0), ("y", "Meme", True, 0, 0), ("y", "Tag", False, 1, 1), ("z", "Tag", False, 0, 2), ("z", "Series", False, 0, 3), ("w", "Meme", True, 0, 0), ("w", "Person", True, 5, 0)]
    got = rows(linking.registry_types(spark.createDataFrame(a, "slug string, type string, is_entry boolean, r int, seq int")))
    assert got == [("w", "Meme"), ("w", "Person"), ("x", "Meme"), ("x", "Tag"), ("y", "Meme"), ("z", "Tag")]


def test_build(spark):
    rows_ = [("1", "Cat", "meme", "Confirmed", "a,b", None, "dog|x", "Pets", "2012.0", "5"), ("2", "Dog", "person", "Confirmed", None, "macro", "['cat']", None, "unknown", None)]
    df = spark.createDataFrame(rows_, ["ID", "Title", "Entry Type", "Status", "Badges", "Formats", "Tags", "Series", "Year", "Views"]).withColumn("r", F.col("ID").cast("int"))
    g = build.build_graph(df)
    types = rows(patterns.types(g))
    assert ("entry/dog", V.TAG) in types and ("entry/dog", V.PERSON) in types and ("entry/cat", V.TAG) not in types
    assert rows(patterns.match(g, p=V.YEAR).select("s", "o")) == [("entry/cat", "2012")]
    assert rows(patterns.match(g, p=V.HAS_BADGE).select("o")) == [("entry/a",), ("entry/b",)]
    assert g.count() == g.distinct().count()


def test_relations(spark):
    rel = [("m", "Ann Lee", "born", "1990"), ("m", "Ann Lee", "part of", "Band X"), ("m", "Ann Lee", "part of", "Band X"), ("m", "a", "b", "cc")]
    g = linking.relation_triples(spark.createDataFrame(rel, "main string, subject string, relation string, object string"), "description")
    assert rows(g.filter("p = 'rel:part_of'").select("s", "o")) == [("entity/ann_lee", "entity/band_x")]
    assert rows(g.filter(F.col("p") == V.BIRTH).select("o")) == [("1990",)]
    assert rows(g.filter(F.col("p") == V.MENTIONS).select("o")) == [("entity/ann_lee",), ("entity/band_x",)]
    assert rows(stats.extraction_stats(g)) == [("description", 1, 1, 2)]
    assert linking.mark_sources(g, "x").count() == 0
    assert linking.parse_relations("<s><triplet> A B <subj> C <obj> likes <subj> D <obj> knows </s>") == [("A B", "likes", "C"), ("A B", "knows", "D")]
    assert linking.parse_relations("<triplet> A <subj> C <obj> likes <subj> D") == [("A", "likes", "C"), ("A", "likes", "D")]
    assert linking.parse_relations("<triplet> A <subj> B <subj> C <obj> r <triplet> E <subj> F <obj> s") == [("A", "r", "B C"), ("E", "s", "F")]
    assert linking.parse_relations("no markers") == [] and linking.parse_relations("<triplet> A <subj> B") == [] and linking.parse_relations(None) == []
    parsed = spark.createDataFrame([("<triplet> A <subj> B <obj> r",)], "t string").select(linking.relations_of(F.col("t")).alias("r")).first().r
    assert [tuple(x) for x in parsed] == [("A", "r", "B")]


def test_links(spark):
    d = spark.createDataFrame([("Q1", "cat", 0), ("Q2", "usa", 1), ("Q3", "dog", 1), ("Q4", "dog", 0)], "id string, label string, src int")
    names = spark.createDataFrame([("The Cat",), ("U.S.A.",), ("dog",), ("%zz",), ("none",)], "name string")
    assert rows(linking.link_labels(names, d)) == [("The Cat", "Q1", "label"), ("U.S.A.", "Q2", "alias"), ("dog", "Q4", "label")]
    c = spark.createDataFrame([("part of", 9), ("part off", 1), ("zzz", 1)], "relation string, n long")
    assert rows(linking.canonical_relations(c)) == [("part off", "part of", pytest.approx(14 / 15, abs=1e-6))]


@pytest.mark.parametrize("n, train", [(1, 1), (2, 1), (3, 2), (5, 4), (10, 8)])
def test_split(spark, n, train):
    df = spark.range(n).withColumn("c", F.lit("a"))
    assert corpus.stratified_split(df, ["c"], "id").filter("split = 'train'").count() == train


def test_unified_and_upsert(spark):
    schema = "filename string, idx long, class_id string, dataset_type string, entry_id long"
    v = spark.createDataFrame([("a", 1, "x", "confirmed", 1), ("a", 4, "y", "u", 2), ("b", 2, "x", "confirmed", 1), ("c", 3, None, "u", 1)], schema)
    t = spark.createDataFrame([("a", 7, "z", "u", 9, "hello"), ("d", 8, "z", "u", 9, "bye")], schema + ", text string")
    got = {r.filename: r for r in corpus.unified_instances(v, t).collect()}
    assert set(got) == {"a", "b", "d"} and (got["a"].class_id, got["a"].vision_idx, got["a"].text_idx, got["a"].modality) == ("x", 4, 7, "both")
    inst = spark.createDataFrame([("i1", "a", None), ("i2", "b", "old"), ("i3", "c", "same"), ("i4", "d", None)], "s string, filename string, old string")
    texts = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "same")], "filename string, text string")
    ch = corpus.ocr_changes(inst, texts)
    assert {r.s: r.change for r in ch.collect()} == {"i1": "add", "i2": "replace", "i3": "unchanged", "i4": "not_found"}
    before = spark.createDataFrame([("i2", V.OCR_TEXT, "old", "literal", V.STRING, None), ("i3", V.OCR_TEXT, "same", "literal", V.STRING, None)], TRIPLES)
    after = corpus.ocr_upsert(before, ch)
    assert rows(after.select("s", "o")) == [("i1", "new"), ("i2", "new"), ("i3", "same")]
    again = corpus.ocr_changes(inst.drop("old").join(after.select("s", F.col("o").alias("old")), "s", "left"), texts)
    assert again.filter("change in ('add', 'replace')").count() == 0
    assert corpus.without_extractions(inst.select("s"), before).count() == 4


def test_dense_subset(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") % 3)
    got = corpus.dense_subset(df, F.col("k") == 1, "id").orderBy("id").collect()
    assert [r.position for r in got] == list(range(333))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[5] = x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q = df.filter("id in (4, 9)")
    exact = {(r.query_id, r.rank): r.id for r in vectors.knn_flat(df, q, 20).collect()}
    for i in (4, 9):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert [exact[i, k + 1] for k in range(20)] == list(np.lexsort((np.arange(300), np.round(d, 9)))[:20])
    assert vectors.knn_flat(df, q, 1000).count() == 600 and vectors.knn_flat(df, q.filter("false"), 5).count() == 0
    blocked = vectors.knn_blocks(df, q, 20, query_block=1, vector_block=64)
    assert {(r.query_id, r.rank): r.id for r in blocked.collect()} == exact
    c = vectors.train_lists(df, 8, 3)
    a = vectors.assign(df, c)
    assert {(r.query_id, r.rank): r.id for r in vectors.knn_ivf(a, q, c, 20, 8).collect()} == exact
    some = {(r.query_id, r.id) for r in vectors.knn_ivf(a, q, c, 20, 4).collect()}
    assert len(some & {(k[0], v) for k, v in exact.items()}) >= 20
    books = vectors.train_codebooks(df, 4, 32, 3)
    coded = {(r.query_id, r.id) for r in vectors.knn_pq(vectors.pq_encode(df, books), q, books, 20).collect()}
    assert len(coded & {(k[0], v) for k, v in exact.items()}) >= 16
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, v array<double>").orderBy("id").select(vectors.normalize(F.col("v")).alias("v")).collect()
    assert sorted(r.v for r in zero) == [[0.0, 0.0], [0.6, 0.8]]


def _recall_of_all_rows(spark, name):
    from graphloom.plans import corpus_queries

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in corpus_queries.QUERIES[name](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    asked = ids % 50 == 0
    assert set(got) == set(ids[asked].tolist()) and all(len(h) == 10 for h in got.values())
    near = ids[np.argsort(((x[asked][:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]]
    return np.mean([len(got[i] & set(n)) / 10 for i, n in zip(ids[asked].tolist(), near.tolist())])


def test_quantised_search_of_all_rows(spark):
    assert _recall_of_all_rows(spark, "knn_pq") >= 0.9


def test_searches_of_all_rows(spark):
    from graphloom.plans import corpus_queries

    assert _recall_of_all_rows(spark, "knn_ivf") >= 0.9
    assert _recall_of_all_rows(spark, "knn_batch") == 1
    folder = "/root/testdata/sf0.01"
    assert corpus_queries.QUERIES["recall_mrr"](spark, folder).first().queries == spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 50 = 0").count()


def test_noise(spark):
    df = spark.range(400).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    got = df.select(vectors.add_noise(F.col("v"), F.col("id")).alias("v")).collect()
    changed = [r.v for r in got if r.v != [1.0, 0.0]]
    assert 80 < len(changed) < 160 and all(abs(a * a + b * b - 1) < 1e-9 and abs(b) < 0.06 for a, b in changed)
    assert got == df.select(vectors.add_noise(F.col("v"), F.col("id")).alias("v")).collect()


def test_anomalies(g, empty):
    got = {r.issue: r.n for r in stats.anomalies(g).collect()}
    assert got == {"type_combinations": 1, "domain_violations": 0, "singleton_properties": 2, "untyped_entities": 0}
    assert {r.n for r in stats.anomalies(empty).collect()} == {0}


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame(rows, "instance string, rank long")
    a, b = hits([("x", 1), ("y", 2), ("z", 3), (None, 4), ("x", 9)]), hits([("y", 1), ("x", 2), ("q", 3), (None, 1)])
    got = vectors.fuse(a, b).collect()
    assert [(r.instance, r.rank_a, r.rank_b) for r in sorted(got, key=lambda r: r.rank)] == [("y", 2, 1), ("x", 9, 2)]
    other = {r.instance: r.score for r in vectors.fuse(b, a).collect()}
    assert other == {r.instance: r.score for r in got}
    m = vectors.retrieval_metrics(spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 1, 1)], "query_id long, id long, rank long"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, class string")).first()
    assert (m.queries, m.recall_1, m.recall_5, m.mrr) == (2, 0.0, 0.5, 0.25)


def test_lineage(spark, g):
    inst = spark.createDataFrame([("i1", V.BELONGS_TO, "m1", *T), ("i2", V.BELONGS_TO, "m1", *T), ("i3", V.BELONGS_TO, "nolabel", *T)], TRIPLES)
    full = g.unionByName(inst)
    b = lineage.bridge(full, spark.createDataFrame([("i2", 1), ("i1", 2), ("i3", 3)], "instance string, rank long"))
    assert rows(b) == [("m1", "One", 2, 1)]
    s = lineage.semantics(full, b)
    assert rows(s) == [("m1", "people", "p1"), ("m1", "tags", "t1")]  # the tag p1 is a person's name
    assert rows(lineage.flow(b, s)) == [("m1", "people:p1", 1), ("query", "m1", 2)]  # a tag of two characters isn't drawn


def test_flow_takes_the_names_of_most_entries(spark):
    bridged = spark.createDataFrame([("e1", "One", 3, 1), ("e2", "Two", 1, 2)], "entry string, label string, hits long, best_rank long")
    names = [("e1", "tags", "the"), ("e2", "tags", "the"), ("e1", "tags", "ab"), ("e1", "subcultures", "x")]
    names += [(e, "people", f"z{i}") for e in ("e1", "e2") for i in range(2)] + [("e1", "people", f"a{i}") for i in range(9)]
    got = rows(lineage.flow(bridged, spark.createDataFrame(names, "entry string, category string, name string")))
    people = [("z0", "e1"), ("z0", "e2"), ("z1", "e1"), ("z1", "e2"), *((f"a{i}", "e1") for i in range(6))]
    assert got == sorted([("query", "e1", 3), ("query", "e2", 1), *((e, f"people:{n}", 1) for n, e in people)])


def test_split_of_few_large_groups(spark):
    df = spark.range(3001).select("id", F.when(F.col("id") < 3000, F.lit("a")).alias("g"), F.lit("x").alias("h"))
    got = corpus.stratified_split(df, ["g", "h"], "id")
    assert got.columns == ["id", "g", "h", "split"]
    assert {tuple(r) for r in got.groupBy("g", "split").count().collect()} == {("a", "test", 600), ("a", "train", 2400), (None, "train", 1)}
    assert corpus.stratified_split(df.filter("false"), ["g", "h"], "id").count() == 0


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)) + 4 * rng.standard_normal((6, 16)).repeat(100, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, None)], "id long, v array<double>")
    vectors.write_index(df, str(tmp_path / "i"), 6, 4, 16, 3)
    index = vectors.read_index(spark, str(tmp_path / "i"))
    assert index.centroids.shape == (6, 16) and [b.shape for b in index.books] == [(16, 4)] * 4
    assert vectors.index_lists(index).agg(F.sum("n")).first()[0] == 600
    q = df.filter("id % 7 = 0")
    exact = rows(vectors.knn_flat(df, q, 5).select("query_id", "id", "rank"))
    assert rows(vectors.knn_ivf_pq(index, df, q, 5, 6, 40).select("query_id", "id", "rank")) == exact
    some = vectors.knn_ivf_pq(index, df, q, 5, 2, 10)
    assert len(set(rows(some.select("query_id", "id", "rank"))) & set(exact)) >= 0.8 * len(exact)
    assert vectors.knn_ivf_pq(index, df, q.filter("false"), 5, 2).count() == 0


def test_names(spark):
    from graphloom.functions import text as X

    df = spark.createDataFrame([("http://schema.org/name",), ("kg:x",), (None,)], "n string")
    assert [r[0] for r in df.select(X.compact(F.col("n"))).collect()] == ["schema:name", "kg:x", None]
    tags = spark.createDataFrame([("The",), (" is ",), ("ab",), ("doge",)], "n string")
    assert [r[0] for r in tags.select(X.valid_tag(F.col("n"))).collect()] == [False, False, False, True]
    assert tags.select(X.shortened(F.col("n"), 2)).first()[0] == "Th"


def test_encoder_reads_whole_texts_of_many_words(spark):
    import hashlib
    import time

    def want(text, dim=16):
        v = np.zeros(dim)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        return v / max(np.linalg.norm(v), 1e-12)

    long = " ".join(f"Word{i % 97}" for i in range(3000)) + " end of it " + "tail " * 500
    texts = [long, "", None, " \t\n ", "\u00c4b a\u2003b A", *(" ".join(f"{i}-{j}" for j in range(40)) for i in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    began = time.perf_counter()
    got = {r.id: r.v for r in df.select("id", vectors.hashing_encoder(16)(F.col("t")).alias("v")).collect()}
    assert time.perf_counter() - began < 30  # each text once went over all words known so far
    assert all(np.allclose(got[i], want(t or ""), atol=1e-12) for i, t in enumerate(texts[:200]))


def test_canonical_relations_by_brute_force(spark, monkeypatch):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcde\u00e9"), rng.integers(1, 9))) for _ in range(400)} | {"ab" * 150, "ab" * 149 + "c"})
    counts = [(w, 9 if i % 3 == 0 else 1) for i, w in enumerate(words)]
    want = []
    for w, n in counts:
        best = max(((SequenceMatcher(None, w, c).ratio(), c.encode()) for c, m in counts if m >= 5), default=None)
        if n < 5 and best[0] >= 0.6:
            want.append((w, best[1].decode(), round(best[0], 6)))
    df = spark.createDataFrame(counts, "relation string, n long")
    assert rows(linking.canonical_relations(df)) == sorted(want)
    monkeypatch.setattr(linking, "SENT_RELATIONS", 50)  # relations in three parts
    assert rows(linking.canonical_relations(df)) == sorted(want)
    scored = []
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: scored.append(1) or 0.0)
    next(linking._best_match(type("Shared", (), {"value": [w for w, n in counts if n > 1]}), 0.6)(iter([pa.RecordBatch.from_pydict({"relation": ["abcd"]})])))
    assert 0 < len(scored) < len(words) / 6  # all that aren't ruled out; most are


def test_toy_relations(spark):
    texts = ["One, two-three  -- FOUR five", " - a\tb c\u00e9d e", "a b", "", None, "x\ny z w", "\u212aelvin IS \u0130t ok"]
    want = [(str(i), *w[:3]) for i, t in enumerate(texts) if t is not None and len(w := [x for x in __import__("re").sub("[^a-z0-9 ]", "", t.lower()).split(" ") if x]) >= 3]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "main string, text string")
    assert rows(linking.toy_relations(df)) == sorted(want)
    assert len(want) >= 3


def test_searches_in_rounds_of_close_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((20, 16)), 60, axis=0) + 1e-4 * rng.standard_normal((1200, 16))  # groups that codes can't tell apart
    x[60:70] = x[60]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    q = df.filter("id % 6 = 0")
    want = []
    for i in range(0, 1200, 6):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 9)
        want += [(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(1200), d))[:10])]
    want.sort()
    hits = lambda df: rows(df.select("query_id", "id", "rank"))
    monkeypatch.setattr(vectors, "SENT_QUERIES", 70)
    monkeypatch.setattr(vectors, "TRAINING_ROWS", 600)
    assert vectors.training(df).count() < 800
    assert hits(vectors.knn_flat(df, q, 10)) == want
    c = vectors.train_lists(vectors.training(df), 8, 3)
    assert hits(vectors.knn_ivf(vectors.assign(df, c), q, c, 10, 8)) == want
    vectors.write_index(df, str(tmp_path / "i"), 8, 4, 16, 2)
    index = vectors.read_index(spark, str(tmp_path / "i"))
    assert index.codes.count() == 1200
    assert hits(vectors.knn_ivf_pq(index, df, q, 10, 8, None)) == want
    some = hits(vectors.knn_ivf_pq(index, df, q, 10, 5, None))
    assert len(set(some) & set(want)) >= 0.9 * len(want)


def test_no_task_groups_more_than_its_rows(spark, monkeypatch):
    from graphloom import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    n = 1000
    df = spark.createDataFrame([*((f"e{i}", V.TYPE, V.EVENT, *T) for i in range(n)), *((f"e{i}", V.TYPE, V.TAG, *T) for i in range(0, n, 4)), *((f"e{i % 500}", V.MENTIONS, f"x{i}", *T) for i in range(n)), (V.MENTIONS, V.DOMAIN, V.PERSON, *T)], TRIPLES)
    assert session.spread(df, "s").rdd.getNumPartitions() == 23
    assert rows(stats.domain_violations(df)) == [(V.MENTIONS, V.PERSON, 1000, 750, 0.75)]
    assert tuple(stats.untyped(df).first()) == (1, 1)
    assert {(r["sub"], r["super"]): r.shared for r in stats.class_overlap(df).collect()} == {(V.TAG, V.EVENT): 250}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_having_spreads_what_it_looks_up(spark, g, monkeypatch):
    from graphloom import session

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    found = patterns.having(patterns.labels(g), g, V.TYPE, V.MEME)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert rows(found) == [("m1", "One"), ("m2", "Two")]
    assert rows(patterns.find_label(g, "o", 5)) == [("m1", "One"), ("m2", "Two")]


def test_structure_counts_long_terms_by_digest(spark, monkeypatch):
    import hashlib

    from graphloom import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    n, text = 1000, "x" * 5000
    short = "\0" + hashlib.sha256(text.encode()).hexdigest()
    df = spark.createDataFrame([*((f"e{i}", V.TYPE, V.EVENT, *T) for i in range(n)), *((f"e{i}", V.MENTIONS, f"e{i % 7}", *T) for i in range(n)), *((f"e{i}", V.OCR_TEXT, t, "literal", V.STRING, None) for i, t in enumerate((text, text, text + "y", short)))], TRIPLES)
    structure = stats.graph_structure(df)
    assert structure.first().asDict() == {"triples": 2004, "edges": 2000, "literal_triples": 4, "subjects": 1000, "iri_objects": 8, "literal_objects": 3, "nodes": 1001, "iri_percent": 99.800399}
    assert "sha2" in plan(structure) and "REPARTITION_BY_NUM" in plan(structure)


def test_inference_sends_uses_past_types(spark):
    n = 1000
    df = spark.createDataFrame([*((f"e{i}", V.TYPE, V.EVENT, *T) for i in range(n)), *((f"e{i}", V.MENTIONS, f"e{i % 7}", *T) for i in range(n))], TRIPLES)
    for side in ("domain", "range"):
        found = stats.inferred_classes(df, side)
        assert "ShuffledHashJoin" in plan(found)
        assert [(r["class"], r.n) for r in found.collect()] == [(V.EVENT, n)]
