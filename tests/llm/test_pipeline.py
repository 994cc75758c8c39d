import functools
import hashlib
import math
import re

import corpus_pipeline
import pytest
from graphloom.llm import langid, mixing, quality, simhash_dedup
from pyspark.sql import functions as F
from test_classifiers import brute_sample, brute_trees, ppm
from test_simhash import brute_groups
from test_tokens import ENCODER, VOCABULARY, brute

SF = "/root/testdata/sf0.001"


def brute_languages(docs):
    """The language of each text that is accepted, by code lengths one byte at a time."""
    samples = {}
    for r in docs:
        samples.setdefault(r.lang, []).append(r.text)
    trees = brute_trees(samples, langid.ORDER, langid.LEAST_SHARE)
    cost = functools.cache(lambda lang, context, symbol: ppm(trees, langid.ORDER, None, lang, context, symbol, None))
    out = {}
    for r in docs:
        b = r.text.encode()
        bits = sorted((sum(cost(k, b[max(0, i - langid.ORDER) : i], b[i]) for i in range(len(b))), k) for k in samples)
        if bits[0][0] <= langid.MAX_BITS * len(b) and bits[1][0] - bits[0][0] >= langid.LEAST_MARGIN:
            out[r.doc_id] = bits[0][1]
    return out


def brute_copies(docs):
    """How often each document comes, from the rate of its source."""
    n = {d.doc_id: len(re.findall(r"[^ \t\n\r]+", d.text)) for d in docs}
    per = {}
    for d in docs:
        per[d.source] = per.get(d.source, 0) + n[d.doc_id]
    out = {}
    for d in docs:
        rate = sum(per.values()) / len(per) / per[d.source]
        draw = int(hashlib.md5(f"{mixing.SEED}:{d.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        out[d.doc_id] = math.floor(rate) + (draw < rate - math.floor(rate))
    return out


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen, tables = docs.columns, docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, SF).write.parquet(str(tmp_path / str(i)))
        seen = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or seen.columns == columns
        tables.append(seen.collect())
    ids = lambda i: {r.doc_id for r in tables[i]}
    _, good = brute_sample(spark, docs, labels)
    assert len(ids(0) ^ good) <= 0.01 * len(good)
    told = brute_languages(tables[0])
    assert {r.doc_id: r.lang for r in tables[1]} == told
    gone = brute_groups({r.doc_id: r.text for r in tables[1]})
    assert len(ids(2) ^ {d for d in ids(1) if d not in gone}) <= 0.05 * len(gone)
    copies = brute_copies(tables[2])
    assert {d: sum(r.doc_id == d for r in tables[3]) for d in ids(2)} == copies
    texts = {r.doc_id: r.text for r in tables[2]}
    assert sorted(r.doc_id for r in tables[4]) == sorted(r.doc_id for r in tables[3])
    for r in {r.doc_id: r for r in tables[4]}.values():
        assert ENCODER.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids) and r.round_trip
    for r in sorted({r.doc_id: r for r in tables[4]}.values(), key=lambda r: len(texts[r.doc_id]))[:150]:
        total, byte_ids = 0.0, set(VOCABULARY.bytes_.values())
        if not byte_ids & set(r.ids):
            total = sum(VOCABULARY.scores[k] for k in r.ids)
            assert total == pytest.approx(brute(texts[r.doc_id]))
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids) for r in whole.collect()) == sorted((r.doc_id, r.ids) for r in tables[4])


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = langid.accepted(quality.resample(docs, labels)).select("doc_id").withColumn("kept", F.lit(1))
    share = {r.quality: r.share for r in labels.join(out, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.2


def test_edges(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for docs, rows in ((edge_docs, edge_docs.count()), (no_docs, 0)):
        outs = {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            outs[name] = [r.asDict() for r in out.select("doc_id", "text", "lang", "source").collect()]
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(encoded) == rows
        if not rows:
            assert not any(outs.values())
            continue
        good, told, lone, mixed = outs.values()
        assert all(r["text"] and r["text"].strip() for r in good) and 5 in {r["doc_id"] for r in good}
        assert all(r["text"] and r["lang"] in ("en", "de") for r in told) and 5 in (told_ids := {r["doc_id"] for r in told}) and 4 not in told_ids
        assert len(lone) == rows  # the copies of 1 share its id or have none
        assert all(r["source"] for r in mixed)
        assert {r.doc_id: len(r.ids) for r in encoded if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    copies = edge_docs.filter("doc_id = 1").withColumn("doc_id", F.lit(77).cast("long"))
    kept = stages["SimHash near-dedup"](spark, edge_docs.unionByName(copies), str(tmp_path))
    assert kept.filter("doc_id = 77").count() == 0 and kept.count() == edge_docs.count()
    assert simhash_dedup.duplicates(copies).count() == 0


def test_names_that_differ_in_case(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "a", 2), (2, "die katze auf der matte", "de", "b", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("_mix_rate", F.lit(2)).withColumn("Mix_Rate", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
