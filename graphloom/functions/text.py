"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def slug(c: Column) -> Column:
    """Lower case, anything but letters, digits and underscores as one underscore; ``unknown`` for nothing, ``item`` for only marks."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"), F.lit("_"))
    return F.when(c.isNull() | (c == ""), F.lit("unknown")).when(out == "", F.lit("item")).otherwise(out)


def uri_safe(c: Column) -> Column:
    """Word characters with underscores for white space, percent-encoded; null for null, empty and ``nan``."""
    out = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("", "nan"), F.lit(None).cast("string")).otherwise(F.url_encode(out))


def predicate_name(c: Column) -> Column:
    """A relation's words as a predicate's local name."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def repair_url(c: Column) -> Column:
    """Puts the colon back into ``https//`` and ``http//`` at the start."""
    return F.regexp_replace(F.trim(c), "^(https?)//", "$1://")


def repair_urls(c: Column) -> Column:
    """``repair_url`` in each item of an array."""
    return F.transform(c, repair_url)


def null_out(c: Column) -> Column:
    """Null for empty texts and ``not found`` in any case."""
    return F.when(c.rlike(r"(?i)^\s*(not found)?\s*$"), F.lit(None).cast("string")).otherwise(c)


def parse_list(c: Column) -> Column:
    """The items of a printed list such as ``['a', "b"]``, without null-like ones; null for other texts.

    Items are cut at quote, comma, quote; an item may hold commas and the other kind of quote.
    """
    inner = F.regexp_extract(c, r"^\s*\[(?s)(.*)\]\s*$", 1)
    items = F.regexp_extract_all(inner, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([^,'"\s][^,'"]*)"""), F.lit(0))
    bare = F.transform(items, lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"""^(['"])(?s)(.*)\1$""", "$2")), r"\\(['\"\\])", "$1"))
    kept = F.filter(bare, lambda x: ~F.lower(x).isin("nan", "null", "none", ""))
    return F.when(c.rlike(r"^\s*\["), kept)


def strip_control(c: Column) -> Column:
    """Without control characters, but with tab, line feed and carriage return."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def strip_punctuation(c: Column) -> Column:
    """Without ASCII punctuation."""
    return F.translate(c, PUNCTUATION, "")


def normalize_label(c: Column) -> Column:
    """A label as it is matched: URL-decoded where it can be, lower case, no quotes, single spaces."""
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)  # a plus sign stays one
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "[\"'`]", ""), "[ \\t\\n\\r]+", " "))


def label_variants(c: Column) -> Column:
    """Ways in which a normalised label may be written, the label first, each once and none empty."""
    bare = F.regexp_replace(c, "^the ", "")
    return F.array_distinct(
        F.filter(
            F.array(
                c, F.replace(c, F.lit("_"), F.lit(" ")), F.replace(c, F.lit(" "), F.lit("_")), F.replace(c, F.lit("."), F.lit("")),
                F.trim(F.regexp_replace(F.replace(c, F.lit("."), F.lit(" ")), " +", " ")), bare, F.when(bare == c, F.concat(F.lit("the "), c)).otherwise(c),
            ),
            lambda x: x != "",
        )
    )


def name_variations(c: Column, nicknames: dict[str, str], most: int = 3) -> Column:
    """Other ways to write a person's name, ``most`` at most: initials with dots, and short or long forms of the first name."""
    first, rest = F.substring_index(c, " ", 1), F.substr(c, F.length(F.substring_index(c, " ", 1)) + 1)
    pairs = nicknames | {v: k for k, v in nicknames.items()}
    other = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[F.lower(first)] if pairs else F.lit(None).cast("string")
    dotted = F.when(first.rlike("^[A-Z]{2,3}$"), F.concat(F.regexp_replace(first, "([A-Z])", "$1."), rest))
    spaced = F.when(first.rlike(r"^([A-Z]\.)+$"), F.concat(F.replace(first, F.lit("."), F.lit("")), rest))
    nick = F.when(other.isNotNull(), F.concat(F.initcap(other), rest))
    return F.slice(F.array_distinct(F.filter(F.array(dotted, spaced, nick), lambda x: x.isNotNull() & (x != c))), 1, most)


def words(c: Column) -> Column:
    """The runs of characters between spaces, tabs and line ends."""
    return F.filter(F.split(c, "[ \\t\\n\\r]+"), lambda w: w != "")


def word_chunks(c: Column, size: int = 512, overlap: int = 100) -> Column:
    """Chunks of ``size`` words that overlap, as (chunk, text); a text of at most ``size`` words stays as it is."""
    w = words(c)
    n = F.size(w)
    step = size - overlap
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / step), F.lit(0)).cast("int")),
        lambda i: F.struct(i.alias("chunk"), F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ").alias("text")),
    )
    return F.when(n > size, many).otherwise(F.array(F.struct(F.lit(0).alias("chunk"), c.alias("text"))))


def ocr_reason(c: Column) -> Column:
    """Why a recognised text is of no use, the first reason that applies, or ``ok``."""
    t, n = F.trim(c), F.size(words(c))
    return (
        F.when(c.isNull() | (F.length(t) < 20), "too_short")
        .when(F.regexp_replace(t, "[ /:.-]", "").rlike("^[0-9]+$"), "digits_only")
        .when(n < 3, "few_words").when(n > 512, "many_words").otherwise("ok")
    )


def trainable(c: Column) -> Column:
    """Whether a text is fit for training: words, characters and at least one run of two letters."""
    return F.coalesce((F.size(words(c)) >= 3) & (F.length(F.trim(c)) >= 10) & c.rlike("[a-zA-Z]{2,}"), F.lit(False))


def year(c: Column) -> Column:
    """A year from 1900 to 2099, also where it was read as a decimal; null otherwise."""
    y = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.when(y.rlike("^(19|20)[0-9]{2}$"), y.cast("int"))


def temporal_predicate(relation: Column, value: Column) -> Column:
    """The predicate for a relation whose object is a time; null where either isn't temporal."""
    r = F.lower(relation)
    is_time = value.rlike("(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])")
    return F.when(
        is_time,
        F.when(r.rlike("birth|born"), "kg:dateOfBirth")
        .when(r.rlike("inception|creat|found|start|publi") & value.rlike("^(19|20)[0-9]{2}$"), "kg:yearCreated")
        .when(r.rlike("inception|creat|found|start|publi"), "kg:dateCreated")
        .when(r.rlike("time|date|year|when"), "kg:temporalDescription"),
    )


def title_case(c: Column) -> Column:
    """Each letter that follows no letter in upper case, the others in lower case."""
    parts = F.regexp_extract_all(c, F.lit(r"(?U)[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def display_label(labels: Column, tail: Column) -> Column:
    """The first label with a capital, else the tail of the name in title case."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x.rlike("[A-Z]")), F.lit(0)), title_case(F.replace(tail, F.lit("_"), F.lit(" "))))


#: Words that are no tags.
STOP_WORDS = """
    a about above after again against all also although an and any are as at back bad be because been before being below between big but by can coming
    could dare doing down during each even few first for found from further get going good got great had has have having here high how if in into is
    it its just large last little long low made many may might more most much must need new no nor not now of off old on once one only or other ought
    out over own said same shall short should small so some still such than that the their them then there these they this those though through to too
    two under up used very was way well were what when where which while who whom why will with would
""".split()


def valid_tag(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Whether a tag is long enough and no stop word."""
    return (F.length(F.trim(c)) >= 3) & ~F.lower(F.trim(c)).isin(*stop)


def basename(c: Column) -> Column:
    """The last part of a path with slashes of either kind."""
    return F.regexp_extract(c, r"[^\\/]*$", 0)


#: Prefixes of the namespaces that ``compact`` knows.
PREFIXES = {"http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:", "http://schema.org/": "schema:", "http://xmlns.com/foaf/0.1/": "foaf:"}


def compact(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """A node's name with the prefix of its namespace in place of it; other names as they are."""
    out = c
    for space, prefix in (PREFIXES if prefixes is None else prefixes).items():
        out = F.when(c.startswith(space), F.concat(F.lit(prefix), F.substr(c, F.lit(len(space) + 1)))).otherwise(out)
    return out


def shortened(c: Column, most: int = 25) -> Column:
    """A label of at most so many characters."""
    return F.substring(c, 1, most)


def local_name(c: Column) -> Column:
    """What follows the last slash, number sign or colon of a name."""
    return F.regexp_extract(c, "[^/#:]*$", 0)


def instance_iri(name: Column, entry: Column) -> Column:
    """A node for an instance: its entry and a digest of its file's name."""
    return F.concat(F.lit("instance/"), slug(entry), F.lit("_"), F.substring(F.md5(name), 1, 12))


def entry_class(c: Column) -> Column:
    """The class of an entry by its category; memes by default."""
    k = F.lower(F.trim(c))
    return (
        F.when(k == "person", "kg:PersonEntry").when(k == "event", "kg:EventEntry").when(k == "site", "kg:SiteEntry")
        .when(k.isin("culture", "subculture"), "kg:SubcultureEntry").otherwise("kg:MemeEntry")
    )


def corrected_class(cls: Column, label: Column) -> Column:
    """The class that a label speaks for where extraction is often wrong."""
    person = (cls == "kg:PersonEntry") & F.lower(label).rlike(r"\b(thread|moment|style|text|effect)$")
    tag = (cls == "kg:Tag") & F.lower(label).rlike("attack|shooting|bombing|trial|election")
    return F.when(person, "kg:MemeEntry").when(tag, "kg:EventEntry").otherwise(cls)


def engagement(views: Column, comments: Column) -> Column:
    """Views and ten times the comments, nulls as none."""
    return F.coalesce(views, F.lit(0)) + F.lit(10) * F.coalesce(comments, F.lit(0))
