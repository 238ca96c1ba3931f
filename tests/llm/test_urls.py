"""Listed URLs against a plain loop, and the filter's own properties."""

import random

from pyspark.sql import functions as F

from veilspark.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url, entries):
    host, path = split(url)
    fit = [(len(h) + len(p), h + p, v) for (h, p), v in entries.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[1], max(fit)[2]) if fit else (None, "allow")


def test_against_a_loop(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "x.org", "com", "É.net", "b.com"]
    entries = {(rng.choice(hosts[:4]), rng.choice(["", "/", "/en/", "/en/7", "/q"])): rng.choice(["allow", "block"]) for _ in range(40)}
    pages = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'WWW.b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/78', '/q?x=/en/', '#/en/', '?a'])}") for i in range(600)]
    pages += [(700, None), (701, ""), (702, "no scheme/en/"), (703, "x://"), (704, "://a.com/en/7"), (705, "http://" + "l." * 200 + "com/" + "p" * 50_000), (706, pages[0][1]), (706, pages[0][1])]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, block string")
    listed = spark.createDataFrame([(h, p, v) for (h, p), v in entries.items()], "host string, path string, verdict string")
    for most in (10**6, 0):
        out = urls.judge(df, listed, max_filter_blocks=most).collect()
        assert len(out) == len(pages)
        for r in out:
            assert (r.host, r.path) == split(r.url) and (r.rule, r.verdict) == judged(r.url, entries) and r.block == "own"


def test_filter_passes_all_listed_and_few_others(spark):
    n = 20_000
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    blocks = -(-n // urls.ENTRIES_A_BLOCK)
    filt = urls.bloom(keys, blocks)
    assert filt.count() <= blocks
    assert urls.possible(keys, filt, blocks, True).count() == n
    others = spark.range(n, 3 * n).select(F.xxhash64("id").alias("h"))
    assert urls.possible(others, filt, blocks, False).count() < 0.03 * 2 * n


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge(pages, none).first().verdict == "allow"
    assert urls.judge(pages.limit(0), none).count() == 0


def test_equal_entries_and_null_parts(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    listed = spark.createDataFrame([("a.com", None, "block"), ("a.com", "", "allow"), (None, "/x", "block"), ("", "/x", "block")], "host string, path string, verdict string")
    r = urls.judge(pages, listed).first()
    assert (r.rule, r.verdict) == ("a.com", "allow")
