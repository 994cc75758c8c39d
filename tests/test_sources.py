import json

from graphloom import vocab as V
from graphloom.operators import corpus
from graphloom.schema import TRIPLES
from graphloom.sources import tables, triples
from graphloom.streaming import upsert
from pyspark.sql import functions as F

ROWS = [("a", V.TYPE, "b", "iri", None, None), ("a", V.LABEL, 'x "y"\n\\n', "literal", V.STRING, None), ("é", "kg:p", "5", "literal", V.INTEGER, None), ("a", V.LABEL, "chat", "literal", None, "fr")]


def key(df):
    return sorted((tuple("" if x is None else x for x in r) for r in df.select(*TRIPLES.names).collect()))


def test_stores_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, TRIPLES)
    triples.write_store(df, f"{tmp_path}/store")
    assert key(triples.read_store(spark, f"{tmp_path}/store")) == key(df)
    triples.write_ntriples(df, f"{tmp_path}/nt")
    assert key(triples.read_ntriples(spark, f"{tmp_path}/nt")) == key(df)


def test_store_prunes(spark, tmp_path):
    triples.write_store(spark.createDataFrame(ROWS, TRIPLES), f"{tmp_path}/store")
    plan = triples.read_store(spark, f"{tmp_path}/store").filter(F.col("p") == V.LABEL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_store_has_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(triples, "FILE_ROWS", 100)
    df = spark.createDataFrame([(f"e{i}", p, "x", "iri", None, None) for i in range(1000) for p in (V.TYPE, V.MENTIONS)], TRIPLES).coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    triples.write_store(df, f"{tmp_path}/store")
    assert before == (spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
    store = triples.read_store(spark, f"{tmp_path}/store")
    assert key(store) == key(df)
    assert {r["count"] for r in store.groupBy("p", F.input_file_name()).count().collect()} == {100}


def test_build_bounds_the_rows_of_a_task(spark, monkeypatch):
    from graphloom import session
    from graphloom.plans import adapter

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    df = adapter.build_entries(spark, sf)
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    tasks = df.filter((F.col("p") == V.MENTIONS) & F.col("s").startswith("order/")).groupBy(F.spark_partition_id()).count().filter("count > 0")
    assert tasks.count() > 5 and tasks.agg(F.sum("count")).first()[0] == items.select("l_orderkey", "l_partkey").distinct().count()
    views = {r.s: r.o for r in df.filter(F.col("p") == V.VIEWS).collect()}
    assert views == {f"part/{r.l_partkey}": str(r["count"]) for r in items.groupBy("l_partkey").count().collect()}


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix k: <http://k/> .\n# note\nk:a a k:T ; k:p "x\\"y", "chat"@fr , 5 ; k:q <http://z> .\nk:b k:n "1"^^k:int .\n')
    got = {(r.s, r.p, r.o, r.o_kind) for r in triples.read_turtle(spark, str(tmp_path / "a.ttl")).collect()}
    assert got == {("http://k/a", "rdf:type", "http://k/T", "iri"), ("http://k/a", "http://k/p", 'x"y', "literal"), ("http://k/a", "http://k/p", "chat", "literal"), ("http://k/a", "http://k/p", "5", "literal"), ("http://k/a", "http://k/q", "http://z", "iri"), ("http://k/b", "http://k/n", "1", "literal")}


def test_entries(spark, tmp_path):
    (tmp_path / "e.csv").write_text('url,id,title,status,related_entities_url,Unnamed: 0\nhttps//k/a,1,A!,Confirmed,"[\'https//k/b\', \'https//k/z\']",0\nhttps//k/b,2,"B\nb",Deadpool,,1\nhttps//k/c,3,not found,submission,,2\nhttps//k/d,4,D,Submission,https//k/b,3\n')
    rows = tables.read_entries(spark, str(tmp_path / "e.csv"))
    assert "Unnamed: 0" not in rows.columns and {r.ID for r in rows.collect()} == {"1", "4"}
    index = spark.createDataFrame([("https://k/b", "old"), ("https://k/b", "Bee")], "url string, title string").coalesce(1)
    clean = {r.ID: r for r in tables.clean_entries(rows, tables.url_index(index)).collect()}
    assert clean["1"].Title == "A" and clean["1"].URL == "https://k/a" and clean["1"].Related == ["Bee", "https://k/z"] and clean["4"].Related == ["Bee"]
    both = tables.combine([rows, rows.withColumn("New", F.lit("n"))])
    assert both.count() == 2 and both.filter("New is not null").count() == 0
    check = tables.structure_check(spark, str(tmp_path / "e.csv")).first()
    assert check.odd_quotes == 2 and check.header_fields == 6
    report = {(r.kind, r.name): r.n for r in tables.status_report(rows, ["ID", "Title"]).collect()}
    assert report["status", "Confirmed"] == 1 and report["filled", "ID"] == 2
    tables.write_entries(rows.select("ID", "Title"), f"{tmp_path}/out")
    assert tables.read_csv(spark, f"{tmp_path}/out").count() == 2
    assert len({r.ID for r in tables.sample(rows, "ID", 1).collect()}) == 1


def test_ocr(spark, tmp_path):
    (tmp_path / "o.csv").write_text("Image Ref,Text,label\nx\\y/cat-1.png,hello there,\ncat-2.png,nan,\ndog.png,b,z\ndog.png,woof woof,z\n")
    got = {r.filename: (r.text, r.class_id, r.n_words) for r in tables.read_ocr(spark, str(tmp_path / "o.csv")).collect()}
    assert got == {"cat-1.png": ("hello there", "cat", 2), "dog.png": ("woof woof", "z", 2)}
    (tmp_path / "p.csv").write_text("file,short,longest\na.png,x,this is the longest column\n")
    assert tables.read_ocr(spark, str(tmp_path / "p.csv")).first().text == "this is the longest column"


def test_images(spark, tmp_path):
    for p in ("cat/a.png", "cat/deep/b.jpg", "dog/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = {(r.filename, r.class_id) for r in tables.read_images(spark, str(tmp_path), "confirmed").collect()}
    assert got == {("a.png", "cat"), ("b.jpg", "deep")}


def test_web_detections(spark, tmp_path):
    (tmp_path / "w.csv").write_text('filename,error,web_entities,best_guess_labels,full_matching_images,timestamp\na.png,,"[{\'entity_id\': \'/m/1\', \'description\': \'Cat\', \'score\': 0.5}]","[{\'label\': \'cat\', \'language_code\': \'en\'}]","[\'u1\', \'u2\']",2020-01-01T00:00:00\nb.png,failed,,,,\n')
    det = tables.read_web_detections(spark, str(tmp_path / "w.csv"))
    inst = spark.createDataFrame([("i1", "a.png"), ("i2", "b.png")], "s string, filename string")
    got = {(r.p, r.o) for r in corpus.web_triples(inst, det).collect()}
    assert ("kg:bestGuess", "cat") in got and ("kg:fullMatches", "2") in got and (V.LABEL, "Cat") in got and ("kg:confidence", "0.5") in got


def test_labels_and_extractions(spark, tmp_path):
    lines = ["[", json.dumps({"id": "Q1", "labels": {"en": {"value": "The Cat"}, "de": {"value": "Katze"}}, "aliases": {"en": [{"value": "kitty"}, {"value": "x"}]}}) + ",", json.dumps({"id": "P9", "labels": {"en": {"value": "prop"}}, "aliases": {}}), "]"]
    (tmp_path / "d.json").write_text("\n".join(lines))
    d = tables.read_label_dump(spark, str(tmp_path / "d.json"))
    assert sorted(map(tuple, d.collect())) == [("Q1", "kitty", 1), ("Q1", "the cat", 0)]
    assert tuple(tables.label_stats(d).first()) == (1, 1, 1)
    (tmp_path / "x.json").write_text(json.dumps({"total_texts": 2, "texts_with_relations": 1, "extractions": {"a.png": [["s", "r", "o"], ["s2", "r2", "o2"]], "b.png": []}}))
    assert sorted(map(tuple, tables.read_extractions(spark, str(tmp_path / "x.json")).collect())) == [("a.png", "s", "r", "o"), ("a.png", "s2", "r2", "o2")]


def test_stream_upsert(spark, tmp_path):
    inst = spark.createDataFrame([("i1", "a"), ("i2", "b")], "s string, filename string")
    write = lambda rows, mode="append": spark.createDataFrame(rows, upsert.TEXTS).coalesce(1).write.mode(mode).parquet(f"{tmp_path}/in")
    run = lambda: upsert.upsert_stream(spark, f"{tmp_path}/in", inst, f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination(60)
    write([("a", "one", 1), ("a", "two", 2), ("b", "x", 1), ("zzz", "q", 1)])
    run()
    assert {r.s: r.old for r in upsert.current_texts(spark, f"{tmp_path}/store").collect()} == {"i1": "two", "i2": "x"}
    write([("a", "three", 3), ("b", "x", 2)])
    run()
    assert {r.s: r.old for r in upsert.current_texts(spark, f"{tmp_path}/store").collect()} == {"i1": "three", "i2": "x"}
    assert spark.read.parquet(f"{tmp_path}/store").filter("epoch = 1").count() == 1


def test_kept_labels_and_vectors(spark, tmp_path):
    d = spark.createDataFrame([("Q2", "b", 0), ("Q1", "a", 1)], "id string, label string, src int")
    tables.write_labels(d, str(tmp_path / "labels"))
    assert sorted(map(tuple, tables.read_labels(spark, str(tmp_path / "labels")).collect())) == sorted(map(tuple, d.collect()))
    v = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0]), (3, "y", [3.0])], "idx long, class_id string, v array<double>")
    tables.write_vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v/vectors")).count() == 3
    assert [(r.class_id, r.popularity) for r in spark.read.json(str(tmp_path / "v/popularity")).orderBy("popularity_rank").collect()] == [("y", 2), ("x", 1)]


def test_latin_texts_and_rejected_lines(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes("file,Text\na-1.png,caf\u00e9 noir\n".encode("latin-1"))
    assert tables.read_ocr(spark, str(tmp_path / "o.csv")).first().text == "caf\u00e9 noir"
    (tmp_path / "t.nt").write_text("<a> <b> <c> .\n# note\n\n<a> b c\n")
    assert tuple(triples.rejected_ntriples(spark, str(tmp_path / "t.nt")).first()) == (1, "<a> b c")
