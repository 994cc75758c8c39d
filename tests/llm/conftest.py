import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in each column, empty and blank texts, a very long text, repeated rows, and names that operators use."""
    long_text = " ".join(f"word{i % 977} of the long text" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (None, "the cat sat on the mat and looked at the dog", "en", "a", 44),
        (2, None, "en", "a", None),
        (3, "", "en", "b", 0),
        (4, " \n\t ", "de", "b", 4),
        (5, long_text, "en", "a", len(long_text)),
        (6, "eine kleine katze sitzt auf der matte und schaut", None, None, 48),
        (7, "a", "en", "c", 1),
        (8, "☃ ünïcödé 漢字 \u0000 end", None, "b", 20),
        (None, None, None, None, None),
        (9, "####", "en", "c", 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["node", "key", "rate", "tokens", "p_good", "gumbel_key", "LANGUAGE_ID", "mix_rate", "v", "s", "root", "g", "with.dot", "canonical", "block", "m0"]
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
