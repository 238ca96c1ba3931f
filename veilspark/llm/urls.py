"""URL filters, in DataFrame operations only.

A list holds canonical entries: a host, a path prefix ("" or "/..."), and a
verdict. An entry fits a URL if its host is the URL's host or a parent domain,
and the URL's path starts with its path. The longest fitting entry decides;
where none fits, the URL is allowed.

An entry's key is its host and path. A URL's candidate keys are all of its
parent domains with all prefixes of its path that have a listed length. Most
candidates of most URLs are not listed: a blocked Bloom filter stops them. A
block is one row (its number and eight 32-bit words), and a key sets one bit in
each word, so a probe is one lookup and eight bit tests. Possible hits go to an
exact join on host and path, which takes out the false positives.

The filter is broadcast while its blocks, counted first, fit max_filter_blocks;
a larger one is joined by block number like any table. No candidate or hit is
dropped, so results are the same either way.

Null URLs and URLs without "://" have an empty host and path. They fit no
entry, as entries have a host, and are allowed; an empty table gives an empty
table, an empty list allows all. Rows that repeat each get the same verdict.
Fitting entries of one length differ in their hosts, and the longer host decides;
of equal entries the least verdict. URLs of any length are judged whole: one has
as many candidates as parent domains times listed path lengths. Other columns
pass as they are; own columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, ascii_lower

WORDS = 8
#: About 10 bits an entry: 25 entries in a block of 256 bits.
ENTRIES_A_BLOCK = 25
#: Blocks that are broadcast at most, 72 bytes each: 72 MB.
MAX_FILTER_BLOCKS = 1_000_000
#: Fixed: odd multipliers that spread a 32-bit hash over the words of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def rest_of(url: Column) -> Column:
    """What follows the first "://", else null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\n"), path)


def bit(h: Column, word: int) -> Column:
    """The bit that a key sets in a word: the top five bits of its lower half times the word's multiplier."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    product = (low * F.lit(SALTS[word] & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(product, 27).cast("int"))


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of a list's key hashes (column h); blocks without a key have no row."""
    return keys.groupBy(block_of(F.col("h"), blocks).alias("block")).agg(*[F.bit_or(bit(F.col("h"), w)).alias(f"w{w}") for w in range(WORDS)])


def possible(candidates: DataFrame, filt: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """The candidates (column h) that the filter passes: all listed ones, and few others."""
    test = F.lit(True)
    for w in range(WORDS):
        test = test & (F.col(f"w{w}").bitwiseAND(bit(F.col("h"), w)) != 0)
    probe = candidates.withColumn("block", block_of(F.col("h"), blocks))
    hit = probe.join(F.broadcast(filt) if broadcast else filt, "block").where(test)
    return hit.drop("block", *[f"w{w}" for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", max_filter_blocks: int = MAX_FILTER_BLOCKS) -> DataFrame:
    """Pages with host, path, rule (host and path of the entry that decides, else null) and verdict.

    listed: (host, path, verdict); of entries with equal host and path the least
    verdict in code point order counts. Own columns named like results are replaced.
    """
    spark = pages.sparkSession
    stash = Stash(spark, "urls")
    entries = listed.where("host is not null and host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    entries = stash.keep(entries.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("h", key_hash(F.col("host"), F.col("path"))))
    n = entries.count()
    blocks = max(1, -(-n // ENTRIES_A_BLOCK))
    filt = bloom(entries, blocks)
    # Lengths of listed paths: a URL's path has at most as many prefixes as it has characters, so this set is bounded by URL length.
    lengths = sorted(r[0] for r in entries.select(F.length("path").alias("n")).distinct().collect())

    results = ("host", "path", "rule", "verdict")
    url = F.col(url_col)
    own = pages.select(*[c for c in pages.columns if c not in results], host_of(url).alias("host"), path_of(url).alias("path"))
    # Equal pairs of host and path are judged once, which also takes the heat out of one host or URL with a third of all rows.
    distinct = own.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    cand = distinct.withColumn("rhost", F.explode(parents)).withColumn("rpath", F.explode(prefixes))
    cand = cand.withColumn("h", key_hash(F.col("rhost"), F.col("rpath")))
    hits = possible(cand, filt, blocks, blocks <= max_filter_blocks)
    exact = hits.join(entries.select(F.col("host").alias("rhost"), F.col("path").alias("rpath"), "verdict"), ["rhost", "rpath"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rhost") + F.length("rpath"), F.length("rhost"), F.concat("rhost", "rpath").alias("rule"), "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), "best.verdict")
    out = own.join(best, ["host", "path"], "left")
    return out.select(*[c for c in pages.columns if c not in results], "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
