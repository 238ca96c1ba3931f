"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, ctw, linededup, mixing, quality, secrets, simhash, toxicity, urls
from .common import Stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Documents from this score on are toxic.
TOXIC_FROM = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"))


#: Fixed by the contract: (host, path, verdict) of the listed URLs.
LISTED = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.repetitions(table(spark, sf_dir, "documents"), nearer=True)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, counts=True, short=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.held_out(parts=7))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = Stash(spark, "secrets").keep(secrets.dictionary(docs))
    model = secrets.train(secrets.findings(spark), known)
    out = secrets.scan(docs, model, known)
    return out.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_quality, op4_simhash, op5_mixing, op6_line_dedup, op7_bpe, op8_ctw, op9_ann, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": URL_SQL, "op3_quality": quality_sql(), "op5_mixing": MIXING_SQL}


MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT *, least(cap, weight * (SELECT arg_min(level, cap / weight + rank * 1e-12) FROM l WHERE cap >= level * weight)) AS target FROM l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size RANGE UNBOUNDED PRECEDING) AS run,
        sum(d.size) OVER (PARTITION BY d.source, d.h, d.doc_id, d.size) AS own
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rest > 0 AND (run <= rest OR run - own < rest AND run - rest < rest - (run - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""

URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                              ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
      FROM p JOIN l ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""


def quality_sql() -> str:
    p = quality.ALPHA / len(quality.RULES)
    rules = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, ({e.replace(' / ', '::DOUBLE / ')})::DOUBLE AS x FROM m" for r, e in quality.RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, (length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals, len(list_filter(w, lambda x: x = '|'))::BIGINT AS n_bars
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m),
x AS ({rules}),
h AS (SELECT x.lang, rule, x, y = 1 AS good FROM x JOIN b ON b.doc_id = x.doc_id AND NOT base_failed JOIN (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = x.doc_id),
s AS (SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND x > cutoff) AS k, count(*) FILTER (NOT good) AS bad, count(*) FILTER (NOT good AND x > cutoff) AS caught
  FROM h, (SELECT unnest({list(quality.GRID)!r}::DOUBLE[]) AS cutoff) GROUP BY lang, rule, cutoff),
t AS (SELECT *, CASE WHEN k >= n * {p!r} THEN 1 ELSE least(1, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p!r}) + (n - i) * ln(1 - {p!r}))))) END AS p_value FROM s WHERE n > 0),
v AS (SELECT *, max(p_value) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING) * (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM t)) <= {quality.DELTA!r} AS safe,
  caught / greatest(bad, 1) - {quality.COST} * k / n AS gain FROM t),
o AS (SELECT lang, rule, cutoff FROM v WHERE safe QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1 AND gain > 0),
z AS (SELECT DISTINCT doc_id FROM x JOIN o ON x.lang IS NOT DISTINCT FROM o.lang AND x.rule = o.rule AND x.x > o.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM z) AS kept FROM b
"""
