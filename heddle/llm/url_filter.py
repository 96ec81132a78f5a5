"""URL filter: host and path rules, then a blocked Bloom filter before an exact join.

Listed canonical URLs set bits in 256-bit blocks (four longs, eight bits a URL).
A page's URL probes one block; only possible hits go on to the exact hash join
with the list, which removes the false positives. Everything is DataFrame
functions.

The Bloom table is broadcast only below broadcast_bytes, by its exact block count;
beyond, it is joined by block like any other table.

Defined cases: a null URL or one without `://` has an empty host, path and no
rule, is never listed, and is allowed. Only a path's very end counts as its end,
not a line feed before it. URLs may be of any length. Repeated rows are judged row by row;
repeated list entries count once; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORDS = 4


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a trailing slash or .html; null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"(\.html|/)\z", "")))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (ties: the first given) and its verdict; null where none fits.

    rules: (verdict, `host/path`) pairs, a short list held by the driver.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> list[Column]:
    """The four longs of a key's mask: two bits in each."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    pos = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(2 * _WORDS)]
    mask = [F.call_function("shiftleft", one, p) for p in pos]
    return [mask[2 * w].bitwiseOR(mask[2 * w + 1]) for w in range(_WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that holds a key: block and its four longs."""
    masks = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_bits(F.col(key)))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], bits_per_key: int = 16, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, canonical, listed.

    pages: page_id, url. listed: canonical (the URLs to block).
    """
    named = listed.select(F.col("canonical").alias("key")).where(F.col("key").isNotNull()).distinct()
    named = materialize(named, "listed")
    n = named.count()
    blocks = max(1, -(-n * bits_per_key // (64 * _WORDS)))
    table = bloom(named, "key", blocks)
    if blocks * 8 * (_WORDS + 1) <= broadcast_bytes:
        table = F.broadcast(table)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    # pages without a host go to any block, so that no block holds them all
    rows = rows.withColumn("block", _block(F.coalesce("canonical", F.col("page_id").cast("string"), F.lit("")), blocks))
    inside = F.lit(True)
    for i, m in enumerate(_bits(F.coalesce("canonical", F.lit("")))):
        inside = inside & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = rows.join(table, "block", "left").withColumn("possible", F.coalesce(inside, F.lit(False)) & F.col("canonical").isNotNull())
    probed = probed.select("page_id", "host", "path", "canonical", "possible")
    hits = probed.where("possible").join(named.withColumn("listed", F.lit(True)), F.col("canonical") == F.col("key"), "left").drop("key")
    rest = probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    judged = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")
