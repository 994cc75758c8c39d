"""The triple table: its columns, its terms, and how rows are melted into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V

TRIPLES = T.StructType(
    [
        T.StructField("s", T.StringType(), False),
        T.StructField("p", T.StringType(), False),
        T.StructField("o", T.StringType(), False),
        T.StructField("o_kind", T.StringType(), False),
        T.StructField("o_datatype", T.StringType(), True),
        T.StructField("o_lang", T.StringType(), True),
    ]
)
COLUMNS = TRIPLES.names


def iri(p: str, o) -> Column:
    """A melted (p, o) whose object is a node; null objects are dropped by ``melt``."""
    return _term(p, o, "iri", None)


def literal(p: str, o, datatype: str = V.STRING) -> Column:
    """A melted (p, o) whose object is a value."""
    return _term(p, o, "literal", datatype)


def _term(p: str, o, kind: str, datatype: str | None) -> Column:
    o = o if isinstance(o, Column) else F.lit(o)
    return F.struct(
        F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    )


def melt(rows: DataFrame, s: Column, *terms: Column, unique: bool = True) -> DataFrame:
    """One triple for each row and term that isn't null, in one scan. Rows that can repeat a triple need ``unique=False``."""
    out = rows.select(s.alias("s"), F.explode(F.array(*terms)).alias("t")).select("s", "t.*").filter("s is not null and o is not null")
    return out if unique else out.distinct()


def as_set(triples: DataFrame) -> DataFrame:
    """The triples as a set."""
    return triples.select(*COLUMNS).distinct()
