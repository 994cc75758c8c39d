"""URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name, own

#: Bits of a block, which is the four longs of one row.
BLOCK_BITS = 256
#: Listed URLs for which a block has room; about 16 bits each.
PER_BLOCK = 16
#: Blocks that are broadcast at most, of about 60 bytes each; a larger filter is joined by a shuffle.
BROADCAST_BLOCKS = 500_000
_SEED = 7

#: Rewrites, in order, of a URL into the one that stands for all its variants; they read alike in Java and RE2.
RULES = [
    (r"#.*$", ""),
    (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
    (r"^[Ww][Ww][Ww]\.", ""),
    (r"^([^/?]*):(80|443)([/?]|$)", r"\1\3"),
    (r"([?&])(utm_[A-Za-z]+|ref|fbclid|gclid)=[^&]*", r"\1"),
    (r"&&+", "&"),
    (r"\?&", "?"),
    (r"[?&]+$", ""),
    (r"/index\.html?(\?|$)", r"/\1"),
    (r"/+$", ""),
    (r"/+\?", "?"),
]


def canonical(url) -> F.Column:
    """The URL without scheme, www., standard port, fragment, tracking parameters, index page and trailing slash, its host in lower case.

    Escapes and the order of parameters are left as they are: URLs that differ in these are different.
    """
    out = F.trim(url)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    host = F.regexp_extract(out, r"^[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(out, F.length(host) + 1))


def canonical_sql(url: str) -> str:
    out = f"trim({url}, ' ')"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"(lower(regexp_extract({out}, '^[^/?]*', 0)) || substr({out}, length(regexp_extract({out}, '^[^/?]*', 0)) + 1))"


def _masks(url) -> list[F.Column]:
    """The eight bits of a URL in its block, as four longs."""
    h = F.xxhash64(F.lit(_SEED), url)
    words = [F.lit(0).cast("long")] * 4
    for i in range(8):
        place = F.shiftright(h, 8 * i).bitwiseAND(F.lit(255))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        words = [w.bitwiseOR(F.when(F.shiftright(place, 6) == k, bit).otherwise(F.lit(0).cast("long"))) for k, w in enumerate(words)]
    return words


def _block(url, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(_SEED + 1), url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, m0..m3): the filter of the URLs in column ``url`` of ``listed``, one row a block in use."""
    rows = listed.select(_block(F.col("url"), blocks).alias("block"), *(m.alias(f"m{k}") for k, m in enumerate(_masks(F.col("url")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(4)))


def unlisted(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose canonical URL is that of no URL in the first column of ``listed``.

    Rows that miss the Bloom filter pass without a shuffle; only possible hits are joined exactly, which
    gives back the false positives. Null URLs, in either table, are never listed. Repeated rows stay or go
    together, and so do URLs of equal canonical form. URLs are read whole, however long; an empty one is a URL
    like others. An empty list lets all rows pass. All columns of ``pages`` are kept, whatever their names. No
    rows give no rows.
    """
    keys = cut(listed.select(canonical(own(listed)[0].cast("string")).alias("url")).dropna().distinct())
    count = keys.count()
    if not count:
        return pages
    blocks = max(1, -(-count // PER_BLOCK))
    filter_ = cut(bloom(keys, blocks))
    c, b, *m = (free_name(pages, x) for x in ("canonical", "block", "m0", "m1", "m2", "m3"))
    filter_ = filter_.toDF(b, *m)
    probed = pages.withColumn(c, canonical(F.col("`" + url.replace("`", "``") + "`").cast("string")))
    probed = probed.withColumn(b, _block(F.col(c), blocks))
    probed = probed.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, b, "left")
    hit = F.col(c).isNotNull()
    for name, mask in zip(m, _masks(F.col(c))):
        hit = hit & (F.coalesce(F.col(name), F.lit(0).cast("long")).bitwiseAND(mask) == mask)
    passed = probed.filter(~hit).select(*own(pages))
    possible = probed.filter(hit).join(keys.select(F.col("url").alias(c)), c, "left_anti").select(*own(pages))
    return passed.union(possible)


#: Hosts whose pages the query lists, as a blocklist does.
BLOCKED_HOSTS = "(spam-farm|cheap-pills|ads-track|casino-win|adult-x|free-bets)\\."


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: every URL of a blocked host, and one in 16 of all, written in another way than in ``pages``."""
    url = F.regexp_replace("url", "^https?", "HTTPS")
    chosen = F.col("url").rlike(BLOCKED_HOSTS) | (F.substring(F.md5(canonical(F.col("url"))), 1, 1) == "0")
    return pages.filter(chosen).select(F.concat(url, F.lit("#listed")).alias("url"))


def sql() -> str:
    own = canonical_sql("url")
    return f"""
WITH listed AS (
  SELECT regexp_replace(url, '^https?', 'HTTPS') || '#listed' AS url FROM pages
  WHERE regexp_matches(url, '{BLOCKED_HOSTS}') OR substr(md5({own}), 1, 1) = '0'
), keys AS (SELECT DISTINCT {own} AS key FROM listed WHERE url IS NOT NULL)
SELECT page_id, url, html FROM (SELECT *, {own} AS key FROM pages) p
WHERE key IS NULL OR key NOT IN (SELECT key FROM keys)
"""
