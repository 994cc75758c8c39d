import pytest
from graphloom.functions import text as X
from pyspark.sql import functions as F


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    "slug": (X.slug, [(None, "unknown"), ("", "unknown"), ("!!!", "item"), ("  A--B  ", "a_b"), ("Café au lait", "caf_au_lait"), ("2012", "2012"), ("__x__", "x")]),
    "uri_safe": (X.uri_safe, [(None, None), ("nan", None), (" a  b! ", "a_b"), ("été", "%C3%A9t%C3%A9")]),
    "repair": (X.repair_url, [("https//a", "https://a"), ("http//b/https//c", "http://b/https//c"), ("plain", "plain"), (None, None)]),
    "null_out": (X.null_out, [("Not Found", None), ("not found ", None), ("", None), ("x not found", "x not found"), (None, None)]),
    "control": (X.strip_control, [("a\x00b\x1f\tc\n", "ab\tc\n"), (None, None)]),
    "punctuation": (X.strip_punctuation, [("a.b-c [d]!", "abc d"), ("\\~`", "")]),
    "label": (X.normalize_label, [("  The  \"Cat\" ", "the cat"), ("a%20b", "a b"), ("%zz", "%zz"), ("c++", "c++"), (None, None)]),
    "reason": (X.ocr_reason, [("x" * 19, "too_short"), ("x y z" + " w" * 8, "ok"), ("12/03/2020 10:30:00.00", "digits_only"), ("a" * 15 + " bbbbbbb", "few_words"), ("ww " * 512, "ok"), ("ww " * 513, "many_words"), (None, "too_short")]),
    "train": (X.trainable, [("one two three", True), ("1 2 3 4 5 6 7", False), ("one two", False), (None, False)]),
    "year": (X.year, [("2012", 2012), ("2012.0", 2012), ("unknown", None), ("1899", None), ("20123", None)]),
    "title": (X.title_case, [("2pac shakur", "2Pac Shakur"), ("o'neil", "O'Neil"), ("ÉTÉ", "Été")]),
    "basename": (X.basename, [("a\\b/c.png", "c.png"), ("c", "c"), ("a/", "")]),
    "local": (X.local_name, [("http://a/b#c", "c"), ("kg:x", "x"), ("part/12", "12")]),
    "class": (X.entry_class, [("Person", "kg:PersonEntry"), ("culture", "kg:SubcultureEntry"), (None, "kg:MemeEntry")]),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    f, rows = CASES[name]
    assert apply(spark, f, [a for a, _ in rows]) == [b for _, b in rows]


def test_lists(spark):
    got = apply(spark, X.parse_list, ["['a', 'b']", '["it\'s", \'c, d\']', "['nan', None, 'x']", "plain", None, "[]"])
    assert got == [["a", "b"], ["it's", "c, d"], ["x"], None, None, []]
    assert apply(spark, lambda c: X.repair_urls(X.parse_list(c)), ["[ 'https//a', 'https://b' ]"]) == [["https://a", "https://b"]]


def test_variants(spark):
    got = dict(zip(["u.s.a.", "the_cat", "the cat"], apply(spark, X.label_variants, ["u.s.a.", "the_cat", "the cat"])))
    assert got["u.s.a."] == ["u.s.a.", "usa", "u s a", "the u.s.a."]
    assert got["the_cat"][:2] == ["the_cat", "the cat"] and "cat" in got["the cat"]


@pytest.mark.parametrize("n, sizes", [(0, [0]), (1, [1]), (412, [412]), (512, [512]), (513, [512, 101]), (924, [512, 512, 100]), (925, [512, 512, 101])])
def test_chunks(spark, n, sizes):
    chunks = apply(spark, X.word_chunks, [" ".join(f"w{i}" for i in range(n))])[0]
    assert [len(c.text.split()) for c in chunks] == sizes and [c.chunk for c in chunks] == list(range(len(sizes)))


def test_temporal(spark):
    df = spark.createDataFrame([("born", "1999"), ("inception", "2010"), ("inception", "March 3rd, 2010"), ("point in time", "May 2011"), ("knows", "2010"), ("inception", "Rome")], "r string, o string")
    got = [r[0] for r in df.select(X.temporal_predicate(F.col("r"), F.col("o"))).collect()]
    assert got == ["kg:dateOfBirth", "kg:yearCreated", "kg:dateCreated", "kg:temporalDescription", None, None]


def test_rest(spark):
    df = spark.createDataFrame([("kg:PersonEntry", "a nice moment", 5, None), ("kg:Tag", "the trial", None, 2), ("kg:Tag", "cats", 1, 1)], "c string, l string, v long, n long")
    assert [r[0] for r in df.select(X.corrected_class(F.col("c"), F.col("l"))).collect()] == ["kg:MemeEntry", "kg:EventEntry", "kg:Tag"]
    assert [r[0] for r in df.select(X.engagement(F.col("v"), F.col("n"))).collect()] == [5, 20, 11]
    assert [r[0] for r in df.select(X.valid_tag(F.col("l"), ["cats"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(X.display_label(F.array(F.lit("abc"), F.lit("aBc")), F.lit("x_y"))).collect()][0] == "aBc"
    assert len({r[0] for r in df.select(X.instance_iri(F.col("l"), F.lit("A b"))).collect()}) == 3
    assert [r[0] for r in df.select(X.predicate_name(F.lit(" Part of! "))).collect()][0] == "part_of"


def test_names(spark):
    got = apply(spark, lambda c: X.name_variations(c, {"bob": "robert"}), ["JK Rowling", "J.K. Rowling", "Bob Ross", "Robert Ross", "Ann", None])
    assert got == [["J.K. Rowling"], ["JK Rowling"], ["Robert Ross"], ["Bob Ross"], [], []]
