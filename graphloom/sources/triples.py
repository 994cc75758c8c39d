"""Triple stores: Parquet by predicate, N-Triples, and a plain subset of Turtle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS
from ..session import settings

_STORE = "s string, o string, o_kind string, o_datatype string, o_lang string, p string"


#: Rows of a file of a store: a reader takes a file at least, and triples are a few bytes there.
FILE_ROWS = 262_144
#: Bytes of a table's file that a task reads while a store is written.
SPLIT_BYTES = 8 << 20
#: Predicates that a task writes at once; rows of further ones are sorted.
WRITERS = 64


def write_store(triples: DataFrame, path: str) -> None:
    """A folder a predicate, so that a bound predicate prunes all other files.

    Tasks write what they make, a file open for each of their predicates: rows are neither sent nor sorted by predicate,
    whose number of rows has no bound, and a task's memory doesn't follow from its rows.
    """
    spark = triples.sparkSession
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS), "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES)}):
        triples.select(*COLUMNS).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("p").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORE).parquet(path).select(*COLUMNS)


def _escaped(c) -> F.Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescaped(c) -> F.Column:
    # a doubled backslash is set aside first, as it ends no other escape
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\u0000"), F.lit("\\"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """A line a triple, as text files."""
    value = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(""))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(value)
    triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value")).write.text(path)


_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


def rejected_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(n, example): the lines that are neither a triple that ``read_ntriples`` takes nor blank nor a comment."""
    bad = spark.read.text(path).filter(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))
    return bad.agg(F.count("*").alias("n"), F.min("value").alias("example"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files, as a set; comments and lines that are no triple are passed over."""
    rows = spark.read.text(path).filter(F.col("value").rlike(_LINE))
    g = lambda i: F.regexp_extract("value", _LINE, i)
    is_iri = F.col("value").rlike(r"^\s*<[^>]*>\s+<[^>]*>\s+<")
    part = lambda i: F.when(~is_iri & (g(i) != ""), g(i))
    return rows.select(g(1).alias("s"), g(2).alias("p"), F.when(is_iri, g(3)).otherwise(_unescaped(g(4))).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), part(5).alias("o_datatype"), part(6).alias("o_lang")).distinct()


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(<[^>]*>|"{3}(?s:.*?)"{3}|"(?:[^"\\\n]|\\.)*"|\^\^|@prefix|@[A-Za-z-]+|[;,.](?=\s|$|[;,.])|[^\s<>"#;,]+?(?=\s*[;,]|\s*\.(?:\s|$)|\s|$))""")


def parse_turtle(text: str) -> Iterator[tuple]:
    """(s, p, o, kind, datatype, lang) of a Turtle text without blank nodes and lists."""
    prefixes: dict[str, str] = {}
    tokens = [m.group(1) for m in _TOKEN.finditer(text) if m.group(1)]

    def name(t: str) -> str:
        if t == "a":
            return "rdf:type"
        if t.startswith("<"):
            return t[1:-1]
        head, _, tail = t.partition(":")
        return prefixes.get(head, head + ":") + tail

    i, s, p = 0, None, None
    while i < len(tokens):
        t = tokens[i]
        if t == "@prefix":
            prefixes[tokens[i + 1].rstrip(":")] = tokens[i + 2][1:-1]
            i += 4
        elif t == ".":
            s = p = None
            i += 1
        elif t == ";":
            p = None
            i += 1
        elif t == ",":
            i += 1
        elif s is None:
            s, i = name(t), i + 1
        elif p is None:
            p, i = name(t), i + 1
        elif t.startswith('"'):
            raw = t[3:-3] if t.startswith('"""') else t[1:-1]
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), raw)
            nxt = tokens[i + 1] if i + 1 < len(tokens) else ""
            if nxt == "^^":
                yield s, p, value, "literal", name(tokens[i + 2]), None
                i += 3
            elif nxt.startswith("@"):
                yield s, p, value, "literal", None, nxt[1:]
                i += 2
            else:
                yield s, p, value, "literal", "xsd:string", None
                i += 1
        elif re.fullmatch(r"[+-]?\d+", t):
            yield s, p, t, "literal", "xsd:integer", None
            i += 1
        elif t in ("true", "false"):
            yield s, p, t, "literal", "xsd:boolean", None
            i += 1
        else:
            yield s, p, name(t), "iri", None, None
            i += 1


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of Turtle files, each parsed whole in one task, as a set."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for t in b.value for r in parse_turtle(t)], columns=COLUMNS)

    return spark.read.text(path, wholetext=True).mapInPandas(run, ", ".join(f"{c} string" for c in COLUMNS)).distinct()
