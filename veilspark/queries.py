"""Registered queries of the privacy engine over the driver's tables, and their oracle SQL."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as O
from .functions import spans as S
from .functions import text as T
from .functions.catalog import MAX_TEXT
from .operators import detect as D
from .operators import fuzzy, gates, layout, search, store
from .sources import archives, files, images, office

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    check = 98 - (k * 1_000_000 + 131_400) % 97 - F.when(k % 5 == 0, 1).otherwise(0)
    return c.select(
        k.alias("doc_id"),
        F.concat(
            F.lit("Name: "), "c_name", F.lit("\nhome address : "), s(k), F.lit(" "), "c_mktsegment", F.lit(" Street\nID "),
            F.lpad(s(k), 5, "0"), F.lit("-"), F.lpad(s(k * 7), 7, "0"), F.lit("-"), s(k % 10),
            F.lit(" IBAN DE"), F.lpad(s(check), 2, "0"), F.lpad(s(k), 18, "0"),
            F.lit(". Mail c"), s(k % 3), F.lit("@example.org, C"), s(k % 3), F.lit("@example.org"),
        ).alias("text"),
    )


FIND = ", kind, s::BIGINT AS span_start, e::BIGINT AS span_end, v AS value FROM a"


def flat(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return D.findings(found, key).select(key, "kind", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "value")


# --- detection ------------------------------------------------------------------


def _kind_query(kind: str, name: str, source, src: str):
    def run(spark, sf_dir):
        return flat(D.detect(source(spark, sf_dir), enabled=[kind]))

    run.__name__ = name
    query(f"WITH RECURSIVE src AS ({src}), {O.accepted('src', [kind])} SELECT doc_id{FIND}")(run)


for _k in ("email", "card", "ipv4", "phone"):
    _kind_query(_k, f"spans_{_k}", documents, "SELECT doc_id, text FROM documents")
for _k in ("cnic", "iban", "name", "address"):
    _kind_query(_k, f"spans_{_k}", contacts, O.CONTACTS)

PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"


@query(f"WITH RECURSIVE src AS ({PAGES}), {O.accepted('src', O.DATA_KINDS)} SELECT doc_id{FIND}")
def spans_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return flat(D.detect(pages, enabled=O.DATA_KINDS))


LITERALS = ("apache license", "un.", "the of")
TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query(f"WITH RECURSIVE src AS ({TURNS}), {O.accepted('src', [], LITERALS)} SELECT doc_id{FIND}")
def spans_custom(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return flat(D.detect(turns, enabled=["custom"], literals=list(LITERALS)))


@query(f"WITH RECURSIVE src AS ({O.CONTACTS}), {O.accepted('src', O.ALL_KINDS, ('building', '@example'))} SELECT doc_id{FIND}")
def resolve_overlaps(spark, sf_dir):
    return flat(D.detect(contacts(spark, sf_dir), literals=["building", "@example"]))


DOCS = "SELECT doc_id, text FROM documents"


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.redacted('src', O.DATA_KINDS)} SELECT doc_id, n::BIGINT AS n_matches, redacted FROM t")
def redact_labels(spark, sf_dir):
    out = D.redact(D.detect(documents(spark, sf_dir)))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_matches"), "redacted")


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.redacted('src', O.DATA_KINDS, blocks=True)} SELECT doc_id, redacted FROM t")
def redact_blocks(spark, sf_dir):
    return D.redact(D.detect(documents(spark, sf_dir)), mode="blocks").select("doc_id", "redacted")


@query(f"WITH RECURSIVE src AS ({O.CONTACTS}), {O.redacted('src', O.ALL_KINDS)} SELECT doc_id, n::BIGINT AS n_matches, redacted FROM t")
def redact_contacts(spark, sf_dir):
    out = D.redact(D.detect(contacts(spark, sf_dir)))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_matches"), "redacted")


@query(f"WITH RECURSIVE src AS ({O.CONTACTS}), {O.redacted('src', O.ALL_KINDS, blocks=True)} SELECT doc_id, redacted AS preview FROM t")
def preview_blocks(spark, sf_dir):
    out = D.redact(D.detect(contacts(spark, sf_dir)))
    return out.select("doc_id", S.blocks_of(F.col("redacted")).alias("preview"))


LABEL_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LABELS.items()) + " END"


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)} SELECT doc_id, kind, {LABEL_CASE} AS label, s::BIGINT AS span_start, e::BIGINT AS span_end, (e - s)::BIGINT AS span_length, '[private value]' AS preview FROM a")
def public_matches(spark, sf_dir):
    found = D.detect(documents(spark, sf_dir)).select("doc_id", F.explode(S.public(F.col("spans"))).alias("m"))
    return found.select("doc_id", "m.kind", "m.label", F.col("m.start").cast("long").alias("span_start"), F.col("m.end").cast("long").alias("span_end"), F.col("m.length").cast("long").alias("span_length"), "m.preview")


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)} SELECT k.kind, count(a.kind) AS n FROM (SELECT unnest(['email','phone','cnic','card','ipv4','iban','name','address','custom']) AS kind) k LEFT JOIN a ON a.kind = k.kind GROUP BY k.kind")
def counts_by_kind(spark, sf_dir):
    return D.counts_by_kind(D.detect(documents(spark, sf_dir)))


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)} SELECT doc_id, kind, count(*) AS n FROM a GROUP BY ALL")
def counts_per_document(spark, sf_dir):
    found = D.detect(documents(spark, sf_dir)).select("doc_id", F.explode(S.counts(F.col("spans"))).alias("kind", "n"))
    return found.select("doc_id", "kind", F.col("n").cast("long").alias("n"))


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)}, n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY ALL) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS findings, coalesce(length(text), 0)::BIGINT AS text_length, 'review_required' AS status FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id")
def scan_report(spark, sf_dir):
    out = D.report(D.detect(documents(spark, sf_dir)))
    return out.select("doc_id", F.col("findings").cast("long"), F.coalesce(F.col("text_length"), F.lit(0)).cast("long").alias("text_length"), "status")


@query(f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 100), {O.accepted('src', O.DATA_KINDS)} SELECT (SELECT count(*) FROM src) AS files, (SELECT count(*) FROM a) AS findings, (SELECT count(*) FROM src WHERE doc_id % 3 = 0) AS outputs")
def stats_newest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = D.report(D.detect(docs)).select("doc_id", "findings")
    reports = found.select(F.lit("t").alias("created"), F.col("doc_id").alias("seq"), "findings", F.when(F.col("doc_id") % 3 == 0, "done").alias("output"))
    return D.stats(reports)


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)}, n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY ALL) SELECT d.doc_id, d.source, coalesce(n, 0)::BIGINT AS findings, (d.doc_id % 4)::BIGINT AS member_count FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id")
def export_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = D.report(D.detect(docs)).withColumn("name", F.lit("private")).withColumn("preview", F.lit("private"))
    out = out.withColumn("members", F.expr("if(doc_id % 4 = 0, cast(array() as array<bigint>), sequence(1, doc_id % 4))"))
    return D.export_report(out).select("doc_id", "source", F.col("findings").cast("long"), F.col("member_count").cast("long"))


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.redacted('src', O.DATA_KINDS)} SELECT t.doc_id, redacted AS clean, n::BIGINT AS removed, sha256(coalesce(d.text, '')) AS source_sha256 FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE NOT (d.doc_id % 7 = 0)")
def clean_text(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("truncated", F.col("doc_id") % 7 == 0)
    out = D.clean(D.detect(docs)).where("clean is not null")
    return out.select("doc_id", "clean", F.col("audit.removed_matches").cast("long").alias("removed"), F.col("audit.source_sha256").alias("source_sha256"))


@query(f"WITH RECURSIVE src AS ({DOCS}), {O.accepted('src', O.DATA_KINDS)} SELECT lang, source, kind, count(*) AS n, (grouping(lang) * 4 + grouping(source) * 2 + grouping(kind))::BIGINT AS level FROM a JOIN documents d ON d.doc_id = a.doc_id GROUP BY CUBE(lang, source, kind)")
def cube_lang_source_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return D.cube_report(D.detect(docs), "lang", "source")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 5 <> 0")
def unchanged_sources(spark, sf_dir):
    docs = documents(spark, sf_dir)
    snapshot = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return D.unchanged(snapshot, docs.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# --- scalar functions -----------------------------------------------------------


@query("SELECT doc_id, substr(text, 1, 500) AS text, length(text) > 500 AS truncated FROM documents")
def truncate_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncated(F.col("text"), 500).alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, off::BIGINT AS off, part FROM (SELECT doc_id, off, substr(text, off + 1, 1800) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 1620)) AS off FROM (SELECT doc_id, substr(text, 1, 250000) AS text FROM documents))) WHERE trim(part, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def text_chunks(spark, sf_dir):
    return search.chunks(documents(spark, sf_dir), F.substring("text", 1, MAX_TEXT), "doc_id").select("doc_id", F.col("offset").cast("long").alias("off"), "part")


NAMES = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', chr(92)) WHEN 2 THEN 'con.' || page_id || '.txt' WHEN 3 THEN ' a*b?' || page_id || '<c>. ' WHEN 4 THEN 'dir/' || repeat('x', 150) || page_id ELSE url || '/' END AS name FROM pages"


def page_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    i, s = F.col("page_id") % 6, F.col("page_id").cast("string")
    name = F.when(i == 0, F.col("url")).when(i == 1, F.replace("url", F.lit("/"), F.lit("\\"))).when(i == 2, F.concat(F.lit("con."), s, F.lit(".txt")))
    name = name.when(i == 3, F.concat(F.lit(" a*b?"), s, F.lit("<c>. "))).when(i == 4, F.concat(F.lit("dir/"), F.repeat(F.lit("x"), 150), s)).otherwise(F.concat("url", F.lit("/")))
    return p.select("page_id", name.alias("name"))


@query(f"""WITH n AS ({NAMES}), l AS (SELECT page_id, substr(trim(regexp_replace(list_extract(string_split(replace(name, chr(92), '/'), '/'), -1), '[<>:"/|?*\\x00-\\x1f\\\\]', '_', 'g'), ' .'), 1, 140) AS x FROM n)
SELECT page_id, CASE WHEN x = '' THEN NULL WHEN upper(split_part(x, '.', 1)) IN ('CON','PRN','AUX','NUL') THEN '_' || x ELSE x END AS clean FROM l""")
def clean_names(spark, sf_dir):
    return page_names(spark, sf_dir).select("page_id", T.clean_name(F.col("name")).alias("clean"))


@query(f"WITH n AS ({NAMES}), m AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(replace(name, 'https://', ''), 'http://', '') WHEN page_id % 4 = 1 THEN '../' || page_id ELSE name END AS name FROM n) SELECT page_id, name <> '' AND NOT contains(name, chr(92)) AND NOT contains(name, ':') AND NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..') AND list_max(list_transform(string_split(name, '/'), lambda x: length(x))) <= 180 AS ok FROM m")
def archive_names(spark, sf_dir):
    i, n = F.col("page_id") % 4, F.col("name")
    bare = F.replace(F.replace(n, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    name = F.when(i == 0, bare).when(i == 1, F.concat(F.lit("../"), F.col("page_id").cast("string"))).otherwise(n)
    return page_names(spark, sf_dir).select("page_id", T.archive_name_ok(name).alias("ok"))


PATHS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'src/' || p_name || '.py' WHEN 1 THEN '.git/' || p_name WHEN 2 THEN 'a/node_modules/' || p_name WHEN 3 THEN 'docs/' || p_name || '.DOCM' ELSE p_brand || '/x.tar.zip' END AS path FROM part"


def part_paths(spark, sf_dir):
    i = F.col("p_partkey") % 5
    path = F.when(i == 0, F.concat(F.lit("src/"), "p_name", F.lit(".py"))).when(i == 1, F.concat(F.lit(".git/"), "p_name")).when(i == 2, F.concat(F.lit("a/node_modules/"), "p_name"))
    path = path.when(i == 3, F.concat(F.lit("docs/"), "p_name", F.lit(".DOCM"))).otherwise(F.concat("p_brand", F.lit("/x.tar.zip")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query(f"SELECT p_partkey, path FROM ({PATHS}) WHERE NOT len(list_filter(string_split(path, '/'), lambda x: x IN ('.git', '.venv', 'venv', 'node_modules', '__pycache__', '.local-data', '.localflow', '.env', '.ssh', '.aws', '.config', 'AppData') OR regexp_full_match(x, 'red .*'))) > 0")
def excluded_paths(spark, sf_dir):
    return part_paths(spark, sf_dir).where(~T.excluded(F.col("path"), (*files.EXCLUDED, "red *")))


@query(f"WITH e AS (SELECT p_partkey, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1)) AS ext FROM ({PATHS})) SELECT p_partkey, ext AS format, CASE ext WHEN '.docm' THEN '.docx' ELSE ext END AS text_format, CASE ext WHEN '.zip' THEN 'archive' WHEN '.docm' THEN 'office' WHEN '.py' THEN 'text' ELSE 'none' END AS export_mode, ext IN ('.zip', '.docm', '.py') AS supported FROM e")
def format_routes(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", T.route(T.suffix(F.col("path"))).alias("r")).select("p_partkey", "r.*")


@query("SELECT o_orderkey, CASE WHEN regexp_matches(ltrim(x), '^[=+@-]') THEN '''' || x ELSE x END AS guarded FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN '  -' || o_orderstatus WHEN 2 THEN o_orderpriority ELSE '@' || o_custkey END AS x FROM orders)")
def formula_guards(spark, sf_dir):
    i = F.col("o_orderkey") % 4
    x = F.when(i == 0, "=1+1").when(i == 1, F.concat(F.lit("  -"), "o_orderstatus")).when(i == 2, F.col("o_orderpriority")).otherwise(F.concat(F.lit("@"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.formula_guard(x).alias("guarded"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 977 ELSE 1000003 END AS n FROM lineitem) SELECT l_orderkey, l_linenumber, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN format('{:.1f} MiB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE format('{:.2f} GiB', floor(n / 1073741824 * 100 + 0.5) / 100) END AS size_text FROM b")
def byte_sizes(spark, sf_dir):
    i = F.col("l_linenumber") % 3
    n = F.floor("l_extendedprice") * F.when(i == 0, 1).when(i == 1, 977).otherwise(1000003)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).select("*", T.byte_size(F.col("n")).alias("size_text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey BETWEEN 5 AND 500 THEN o_custkey END AS n FROM orders")
def strict_integers(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.integer(x, 5, 500).alias("n"))


@query("SELECT p_partkey, lower(regexp_replace(p_name || '-' || p_type || '_' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS normal FROM part")
def normalize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalized(F.concat_ws("_", F.concat_ws("-", "p_name", "p_type"), "p_brand")).alias("normal"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, least(levenshtein(a.p_name, b.p_name), 3)::BIGINT AS d FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def bounded_distance(spark, sf_dir):
    return fuzzy.distances(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_size", 2).select("a", "b", F.col("d").cast("long"))


@query("WITH e AS (SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS t FROM benchmark) SELECT item_id, regexp_replace(t, '(the|on|les)', '<mark>\\1</mark>', 'gi') AS html FROM e")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.highlighted(F.col("text"), "the on, les!").alias("html"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '://([a-z]+)\\.', 1), ''), regexp_extract(url, '://([a-z]+)\\.', 0)) AS first FROM pages")
def first_matches(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.first_match(F.col("url"), r"://([a-z]+)\.").alias("first"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ' + ' ORDER BY event_type) AS methods FROM events GROUP BY user_id")
def page_methods(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(T.methods_of(F.collect_set("event_type")).alias("methods"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16' ELSE 'UTF-8' END AS method, text FROM documents")
def decode_text(spark, sf_dir):
    i = F.col("doc_id") % 3
    bom = F.unhex(F.lit("EFBBBF"))
    raw = F.when(i == 0, F.concat(bom, F.col("text").cast("binary"))).when(i == 1, F.encode("text", "UTF-16")).otherwise(F.col("text").cast("binary"))
    return documents(spark, sf_dir).select("doc_id", T.decoded(raw).alias("r")).select("doc_id", "r.method", "r.text")


@query("SELECT doc_id, 'Windows-1252' AS method, 'caf' || chr(233) || ' ' || chr(8364) || doc_id AS text FROM documents")
def decode_western(spark, sf_dir):
    raw = F.concat(F.lit("caf").cast("binary"), F.unhex(F.lit("E92080")), F.col("doc_id").cast("string").cast("binary"))
    return documents(spark, sf_dir).select("doc_id", T.decoded(raw).alias("r")).select("doc_id", "r.method", "r.text")


# --- positioned words ---------------------------------------------------------------


def words(spark, sf_dir):
    """All words of all documents, with made-up places: eight to a line, three lines to a page, every eleventh native."""
    # Dealt by document while rows are texts: what follows is by document and more, and moves no words.
    docs = documents(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    each = docs.select("doc_id", F.posexplode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("pos", "text"))
    p, col, row = F.col("pos"), (F.col("pos") % 8).cast("double"), F.floor(F.col("pos") / 8).cast("double")
    return each.select(
        "doc_id", (1 + F.floor(p / 24)).cast("int").alias("page"), p.alias("word_no"), "text", row.cast("int").alias("line"),
        (col * 90).alias("x0"), (col * 90 + 8.0 * F.length("text")).alias("x1"), (row * 30).alias("y0"), (row * 30 + 20).alias("y1"),
        (p % 11 != 5).alias("is_ocr"), F.when(p % 11 != 5, ((F.col("doc_id") * 7 + p * 13) % 101).cast("double")).alias("confidence"),
    )


def placed(spark, sf_dir):
    return layout.with_offsets(words(spark, sf_dir))


@query(O.with_words("SELECT doc_id, word_no::BIGINT AS word_no, s AS word_start, (s + length(text))::BIGINT AS word_end, text FROM o"))
def word_offsets(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", F.col("word_no").cast("long"), F.col("start").cast("long").alias("word_start"), F.col("end").cast("long").alias("word_end"), "text")


@query(O.with_words("SELECT doc_id, text FROM txt"))
def word_texts(spark, sf_dir):
    return layout.rebuilt(placed(spark, sf_dir))


RUNS = """, b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR NOT is_ocr OR NOT lag(is_ocr) OVER w
   OR least(lag(y1) OVER w, y1) - greatest(lag(y0) OVER w, y0) < 0.5 * greatest(1, least(lag(y1) OVER w - lag(y0) OVER w, y1 - y0))
   OR x0 < lag(x0) OVER w OR x0 - lag(x1) OVER w > greatest(20, 2 * greatest(1, least(lag(y1) OVER w - lag(y0) OVER w, y1 - y0))) THEN 1 ELSE 0 END AS br
   FROM o WINDOW w AS (PARTITION BY doc_id, page ORDER BY s)),
ru AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, page ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)"""


@query(O.with_words("" + RUNS + " SELECT doc_id, page::BIGINT AS page, word_no::BIGINT AS word_no, run FROM ru WHERE is_ocr").replace(")\n, b AS", "),\nb AS"))
def ocr_runs(spark, sf_dir):
    w = placed(spark, sf_dir)
    return layout.runs(w, layout.rebuilt(w)).select("doc_id", F.col("page").cast("long"), F.col("word_no").cast("long"), F.col("run").cast("long"))


@query(O.with_words(", hits AS (SELECT doc_id, word_no, s AS ms, s + 3 AS me FROM o WHERE word_no % 9 = 4) SELECT DISTINCT o.doc_id, page::BIGINT AS page, o.word_no::BIGINT AS word_no, greatest(0, floor(x0 * 2) - 2)::BIGINT AS rx0, greatest(0, floor(y0 * 2) - 2)::BIGINT AS ry0, least(1200, ceil(x1 * 2) + 2)::BIGINT AS rx1, least(400, ceil(y1 * 2) + 2)::BIGINT AS ry1 FROM o JOIN hits h ON h.doc_id = o.doc_id AND s < me AND ms < s + length(text) WHERE greatest(0, floor(x0 * 2) - 2) < least(1200, ceil(x1 * 2) + 2) AND greatest(0, floor(y0 * 2) - 2) < least(400, ceil(y1 * 2) + 2)").replace(")\n, hits", "),\nhits"))
def mask_regions(spark, sf_dir):
    w = placed(spark, sf_dir)
    hits = w.where("word_no % 9 = 4").select("doc_id", "start", (F.col("start") + 3).alias("end"))
    out = layout.regions(w, hits, 2.0, 1200, 400)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("page", "word_no", "rx0", "ry0", "rx1", "ry1")])


@query(O.with_words("SELECT doc_id, word_no::BIGINT AS word_no, CASE word_no % 4 WHEN 1 THEN [1000 - y1, x0, 1000 - y0, x1] WHEN 2 THEN [1000 - x1, 800 - y1, 1000 - x0, 800 - y0] WHEN 3 THEN [y0, 800 - x1, y1, 800 - x0] ELSE [x0, y0, x1, y1] END[1] AS bx0, CASE word_no % 4 WHEN 1 THEN [1000 - y1, x0, 1000 - y0, x1] WHEN 2 THEN [1000 - x1, 800 - y1, 1000 - x0, 800 - y0] WHEN 3 THEN [y0, 800 - x1, y1, 800 - x0] ELSE [x0, y0, x1, y1] END[4] AS by1 FROM o"))
def undo_rotations(spark, sf_dir):
    box = layout.undo_rotation(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("word_no") % 4 * 90, F.lit(1000.0), F.lit(800.0))
    return words(spark, sf_dir).select("doc_id", F.col("word_no").cast("long"), box.alias("b")).select("doc_id", "word_no", F.col("b")[0].alias("bx0"), F.col("b")[3].alias("by1"))


@query(O.with_words(", m AS (SELECT doc_id, page, word_no, is_ocr, CASE WHEN word_no % 11 IN (4, 6) THEN x0 + 40 ELSE x0 END AS x0, CASE WHEN word_no % 11 IN (4, 6) THEN x1 + 140 ELSE x1 END AS x1, y0, y1 FROM o) SELECT doc_id, page::BIGINT AS page, word_no::BIGINT AS word_no FROM m WHERE NOT is_ocr OR NOT EXISTS (SELECT 1 FROM m n WHERE NOT n.is_ocr AND n.doc_id = m.doc_id AND n.page = m.page AND (m.x0 + m.x1) / 2 BETWEEN n.x0 AND n.x1 AND (m.y0 + m.y1) / 2 BETWEEN n.y0 - 2 AND n.y1 + 2)").replace(")\n, m AS", "),\nm AS"))
def without_native(spark, sf_dir):
    near = F.col("word_no") % 11
    w = words(spark, sf_dir).withColumn("x0", F.when(near.isin(4, 6), F.col("x0") + 40).otherwise(F.col("x0"))).withColumn("x1", F.when(near.isin(4, 6), F.col("x1") + 140).otherwise(F.col("x1")))
    return layout.without_native(w).select("doc_id", F.col("page").cast("long"), F.col("word_no").cast("long"))


@query(O.with_words("SELECT doc_id, text, line2 AS line, row_number() OVER (PARTITION BY doc_id, page ORDER BY line2, x0, word_no) AS word_no FROM (SELECT *, round_even(y0 / 4, 0)::BIGINT AS line2 FROM o)"))
def reading_order(spark, sf_dir):
    return layout.reading_order(words(spark, sf_dir)).select("doc_id", "text", F.col("line").cast("long"), F.col("word_no").cast("long"))


EDGES = [200.0, 450.0]


@query(O.with_words(", c AS (SELECT doc_id, page, line, (x0 >= 200)::INT + (x0 >= 450)::INT AS col, string_agg(text, ' ' ORDER BY x0, word_no) AS cell FROM o GROUP BY ALL) SELECT doc_id, page::BIGINT AS page, line::BIGINT AS line, coalesce(max(cell) FILTER (col = 0), '') AS c0, coalesce(max(cell) FILTER (col = 1), '') AS c1, coalesce(max(cell) FILTER (col = 2), '') AS c2 FROM c GROUP BY ALL").replace(")\n, c AS", "),\nc AS"))
def table_edges(spark, sf_dir):
    out = layout.table_by_edges(words(spark, sf_dir), EDGES)
    return out.select("doc_id", F.col("page").cast("long"), F.col("line").cast("long"), *[F.col("cells")[i].alias(f"c{i}") for i in range(3)])


GAPS = ", n AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > greatest(14, 720 / 30) THEN 1 ELSE 0 END AS br FROM o WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, word_no)), k AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, page, line ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS cell FROM n), c AS (SELECT doc_id, page, line, cell, string_agg(text, ' ' ORDER BY x0, word_no) AS t FROM k GROUP BY ALL)"


@query(O.with_words(GAPS + " SELECT doc_id, page::BIGINT AS page, line::BIGINT AS line, string_agg(t, '|' ORDER BY cell) AS cells, count(*) AS n FROM c GROUP BY ALL").replace(")\n, n AS", "),\nn AS"))
def table_gaps(spark, sf_dir):
    out = layout.table_by_gaps(words(spark, sf_dir), 720.0)
    return out.select("doc_id", F.col("page").cast("long"), F.col("line").cast("long"), F.array_join("cells", "|").alias("cells"), F.size("cells").cast("long").alias("n"))


@query(O.with_words(GAPS + ", q AS (SELECT doc_id, page, line, count(*) AS n FROM c GROUP BY ALL) SELECT doc_id, page::BIGINT AS page, count(*) AS n_rows, max(n)::BIGINT AS n_columns, sum(n)::BIGINT AS n_cells FROM q GROUP BY ALL").replace(")\n, n AS", "),\nn AS"))
def table_sizes(spark, sf_dir):
    out = layout.table_size(layout.table_by_gaps(words(spark, sf_dir), 720.0))
    return out.select("doc_id", F.col("page").cast("long"), F.col("n_rows").cast("long"), F.col("n_columns").cast("long"), F.col("n_cells").cast("long"))


@query("SELECT o_orderkey, o_totalprice > 0 AND o_totalprice < o_totalprice + o_custkey AND o_totalprice + o_custkey < 200000 AS ok FROM orders")
def edges_valid(spark, sf_dir):
    edges = F.array(F.col("o_totalprice"), F.col("o_totalprice") + F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", layout.edges_ok(edges, F.lit(200000.0)).alias("ok"))


@query(O.with_words("SELECT doc_id, word_no::BIGINT AS word_no, (x0 >= 0 AND x0 < x1 AND x1 <= 601 AND y0 >= 0 AND y0 < y1 AND y1 <= 201) AS valid FROM o"))
def valid_words(spark, sf_dir):
    w = placed(spark, sf_dir)
    pages = w.select("doc_id", "page").distinct().withColumn("width", F.lit(599.5)).withColumn("height", F.lit(200.0))
    return layout.valid_words(w, pages, layout.rebuilt(w)).select("doc_id", F.col("word_no").cast("long"), "valid")


@query(O.with_words(", au AS (SELECT doc_id, page, floor(x0)::BIGINT AS a, floor(y0)::BIGINT AS b FROM o WHERE word_no % 20 = 0), ma AS (SELECT DISTINCT doc_id, page, 5::BIGINT AS a, 6::BIGINT AS b FROM o WHERE page = 1) SELECT doc_id, page::BIGINT AS page, count(*) AS n FROM (SELECT * FROM au UNION ALL SELECT * FROM ma) GROUP BY ALL").replace(")\n, au AS", "),\nau AS"))
def merged_regions(spark, sf_dir):
    w = words(spark, sf_dir)
    box = [F.floor("x0").cast("int").alias("rx0"), F.floor("y0").cast("int").alias("ry0"), F.ceil("x1").cast("int").alias("rx1"), F.ceil("y1").cast("int").alias("ry1")]
    auto = w.where("word_no % 20 = 0").select("doc_id", "page", *box)
    manual = w.where("page = 1").select("doc_id", "page").distinct().selectExpr("*", "5 as rx0", "6 as ry0", "50 as rx1", "60 as ry1")
    return layout.merged_regions(auto, manual).select("doc_id", F.col("page").cast("long"), "n")


# --- recognised text ------------------------------------------------------------------

RULES = ["Inquerable Secret", "Licensed Apache", "AAAAAAAA", "short"]


def noisy_words(spark, sf_dir):
    """The words, with two values written in by place: exact, split, with one and with two wrong letters."""
    w = words(spark, sf_dir)
    n, d = F.col("word_no"), F.floor(F.col("doc_id") / 10) % 4
    first = F.when(d == 0, "Inquerable").when(d == 1, "lnquerable").when(d == 2, "lnquerab1e").otherwise("Inquer_able")
    text = F.when(n == 9, first).when(n == 10, F.when(d == 3, "Secrat").otherwise("Secret")).when(n == 25, "Licensed").when(n == 26, "Apache").otherwise(F.col("text"))
    w = w.withColumn("text", text).withColumn("x1", F.col("x0") + F.when(n.isin(9, 25), 85.0).otherwise(8.0 * F.length(text)))
    return layout.with_offsets(w)


#: All sequences of tokens of all runs, by length, against both usable rules; `covered` are the words of exact values.
NOISY = (
    """, nz0 AS (SELECT * REPLACE (CASE WHEN word_no = 9 THEN CASE doc_id // 10 % 4 WHEN 0 THEN 'Inquerable' WHEN 1 THEN 'lnquerable' WHEN 2 THEN 'lnquerab1e' ELSE 'Inquer_able' END
    WHEN word_no = 10 THEN CASE WHEN doc_id // 10 % 4 = 3 THEN 'Secrat' ELSE 'Secret' END WHEN word_no = 25 THEN 'Licensed' WHEN word_no = 26 THEN 'Apache' ELSE text END AS text) FROM words),
oz AS MATERIALIZED (SELECT * REPLACE (x0 + CASE WHEN word_no IN (9, 25) THEN 85 ELSE 8.0 * length(text) END AS x1), CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   + row_number() OVER (PARTITION BY doc_id ORDER BY word_no) - 1 + (page - 1) AS BIGINT) AS s FROM nz0)"""
    + RUNS.replace("FROM o WINDOW", "FROM oz WINDOW")
    + r""", cut AS (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t, regexp_extract_all(text, '[^\p{L}\p{N}]+') AS g, regexp_matches(text, '^[^\p{L}\p{N}]')::INT AS late FROM ru WHERE is_ocr),
tk0 AS (SELECT doc_id, page, run, word_no, confidence, s, t, g, late, unnest(range(1, len(t) + 1)) AS k FROM cut),
tk1 AS (SELECT doc_id, page, run, word_no, confidence, s + coalesce(list_sum(list_transform(t[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:k - 1 + late], lambda x: length(x))), 0) AS place, t[k] AS tok FROM tk0),
tk AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(length(v)) OVER w AS upto, doc_id // 10 % 4 = 0 AND word_no IN (9, 10) OR word_no IN (25, 26) AS covered
  FROM (SELECT *, regexp_replace(replace(lower(tok), 'ß', 'ss'), '[^\x00-\x7f]', '#', 'g') AS v FROM tk1) WINDOW w AS (PARTITION BY doc_id, page, run ORDER BY place)),
joined AS (SELECT doc_id, page, run, string_agg(v, '' ORDER BY i) AS whole FROM tk GROUP BY ALL),
rule(rule_id, target, most) AS (VALUES (1, 'inquerablesecret', 2), (2, 'licensedapache', 1)),
seq AS (SELECT x.doc_id, x.page, x.run, x.i AS a, y.i AS b, x.place AS s, y.place + length(y.tok) AS e, rule_id, target, most, substr(whole, (x.upto - length(x.v) + 1)::BIGINT, (y.upto - x.upto + length(x.v))::BIGINT) AS got
  FROM tk x JOIN tk y ON y.doc_id = x.doc_id AND y.page = x.page AND y.run = x.run AND y.i BETWEEN x.i AND x.i + 18
  JOIN rule ON y.upto - x.upto + length(x.v) BETWEEN length(target) - most AND length(target) + most JOIN joined j ON j.doc_id = x.doc_id AND j.page = x.page AND j.run = x.run),
near AS MATERIALIZED (SELECT *, levenshtein(got, target) AS edits FROM seq WHERE levenshtein(got, target) <= most),
kept AS (SELECT n.doc_id, n.page, n.rule_id, n.s, n.e, n.edits, min(t.confidence) AS confidence FROM near n JOIN tk t ON t.doc_id = n.doc_id AND t.page = n.page AND t.run = n.run AND t.i BETWEEN n.a AND n.b
  GROUP BY ALL HAVING NOT bool_and(t.covered))"""
)


@query(O.with_words(NOISY + " SELECT doc_id, rule_id::BIGINT AS rule_id, page::BIGINT AS page, s::BIGINT AS span_start, e::BIGINT AS span_end, CASE WHEN edits = 0 THEN 'normalized' ELSE 'edit-distance' END AS method, edits::BIGINT AS edits, confidence FROM kept").replace(")\n, nz0", "),\nnz0"))
def fuzzy_matches(spark, sf_dir):
    w = noisy_words(spark, sf_dir)
    texts = layout.rebuilt(w)
    docs = D.detect(texts, enabled=["custom"], literals=RULES)
    found = fuzzy.matches(docs, w, RULES, layout.runs(w, texts))
    return found.select("doc_id", F.col("rule_id").cast("long"), F.col("page").cast("long"), F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "method", F.col("edits").cast("long"), "confidence")


@query(O.with_words(NOISY + """, whole AS (SELECT doc_id, lower(string_agg(text, ' ' ORDER BY word_no)) AS t FROM oz GROUP BY doc_id),
un AS (SELECT w.doc_id, string_agg(r.rule_id::VARCHAR, ',' ORDER BY r.rule_id) FILTER (NOT contains(t, lit) AND n.doc_id IS NULL) AS ids
  FROM whole w CROSS JOIN (VALUES (1, 'inquerable secret'), (2, 'licensed apache'), (3, 'aaaaaaaa'), (4, 'short')) r(rule_id, lit) LEFT JOIN (SELECT DISTINCT doc_id, rule_id FROM near) n ON n.doc_id = w.doc_id AND n.rule_id = r.rule_id GROUP BY w.doc_id),
c AS (SELECT doc_id, count(*) AS n, bool_or(confidence < 60) AS weak FROM kept GROUP BY doc_id)
SELECT un.doc_id, coalesce(ids, '') AS unmatched, '3,4' AS too_short, coalesce(n, 0) AS n_candidates, coalesce(weak, false) AS weak, ids IS NOT NULL AS requires_confirmation,
  concat_ws(',', CASE WHEN n > 0 THEN 'near_matches' END, CASE WHEN weak THEN 'low_or_unknown_score' END, CASE WHEN ids IS NOT NULL THEN 'unmatched_rules' END, 'short_rules') AS warnings
FROM un LEFT JOIN c ON c.doc_id = un.doc_id""").replace(")\n, nz0", "),\nnz0"))
def fuzzy_review(spark, sf_dir):
    w = noisy_words(spark, sf_dir)
    texts = layout.rebuilt(w)
    out = fuzzy.warnings(fuzzy.review(D.detect(texts, enabled=["custom"], literals=RULES), layout.runs(w, texts), RULES))
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return out.select("doc_id", joined("unmatched_rule_ids", "unmatched"), joined("short_rule_ids", "too_short"), "n_candidates", "weak", "requires_confirmation", joined("warnings", "warnings"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT ps.p_partkey AS child, ps.p_partkey // 2 AS parent FROM part ps), h AS (SELECT 3::BIGINT AS child UNION SELECT e.child FROM e JOIN h ON e.parent = h.child) SELECT child FROM h""")
def style_levels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    return layout.closure(p, spark.createDataFrame([(3,)], "child long"))


@query("SELECT DISTINCT n_nationkey AS child FROM nation WHERE n_regionkey = 1 OR n_nationkey IN (SELECT 100 + r_regionkey FROM region) UNION SELECT 101")
def style_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("child"), (100 + F.col("n_regionkey")).cast("int").alias("parent"))
    return layout.closure(n, spark.createDataFrame([(101,)], "child int"))


# --- gates -------------------------------------------------------------------------------


@query(O.with_words("SELECT doc_id, page::BIGINT AS page, string_agg(text, ' ' ORDER BY CASE WHEN page % 3 = 0 THEN -word_no ELSE word_no END) AS flow FROM o GROUP BY doc_id, page HAVING page % 3 = 0 AND string_agg(text, ' ' ORDER BY word_no) <> string_agg(text, ' ' ORDER BY -word_no)"))
def second_views(spark, sf_dir):
    w = words(spark, sf_dir)
    order = F.when(F.col("page") % 3 == 0, -F.col("word_no")).otherwise(F.col("word_no"))
    chars = w.select("doc_id", "page", order.alias("ordinal"), F.concat("text", F.lit(" ")).alias("text"))
    return gates.second_views(w, chars).select("doc_id", F.col("page").cast("long"), F.rtrim("flow").alias("flow"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, max(l_quantity)::BIGINT % 5 AS n FROM lineitem GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p),
w AS (SELECT doc_id, page, i, n, least(least(n, 3), 6) AS used, CASE WHEN n < 4 THEN n END AS hit FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.page, q.i, q.n, least(w.used + least(q.n, 3), 6), CASE WHEN q.n < 4 AND (q.n = 0 OR w.used + q.n <= 6) THEN q.n END FROM w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i + 1)
SELECT doc_id::BIGINT AS doc_id, page::BIGINT AS page, (hit * 90)::BIGINT AS angle, hit IS NULL AS unresolved FROM w""")
def turned_pages(spark, sf_dir):
    n = F.col("q").cast("long") % 5
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    hits = pages.select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.when(n < 4, F.array((n * 90).cast("int"))).otherwise(F.array().cast("array<int>")).alias("angles"))
    return gates.turned_pages(hits).select("doc_id", "page", F.col("angle").cast("long"), "unresolved")


@query("SELECT o_orderkey::BIGINT AS doc_id, (o_custkey % 3)::BIGINT AS removed_matches, (o_custkey % 2)::BIGINT AS selected_regions, (o_custkey % 3 + o_custkey % 2)::BIGINT AS painted_regions FROM orders WHERE o_custkey % 3 > 0 OR o_custkey % 2 > 0")
def painted_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"), "o_custkey")
    times = lambda n: o.select("doc_id", F.explode(F.array_repeat(F.lit(0), (F.col("o_custkey") % n).cast("int"))).alias("i"))
    return gates.painted(times(3), times(3), times(2))


@query("SELECT DISTINCT o_custkey::BIGINT AS doc_id, 'regions_required' AS error FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def without_masks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), "o_orderkey")
    return gates.without_masks(o, o.where("o_orderkey % 4 = 0"))


@query("SELECT p_partkey::BIGINT AS p_partkey, p_partkey % 4 < 2 AS inside FROM part")
def contained_paths(spark, sf_dir):
    tail = F.element_at(F.array(F.lit("/out/a"), F.lit("/out//b/../c"), F.lit("/out/../x"), F.lit("/outer/a")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), gates.within(tail, F.lit("/out")).alias("inside"))


# --- search -----------------------------------------------------------------------------

SEARCHED = "SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark"


def benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("name"), "text")


ASKED = "the tion and ntble of thereon"


@query("""WITH d AS (SELECT item_id AS id, chr(10) || text AS part FROM benchmark), n AS (SELECT count(*)::DOUBLE AS n FROM d),
w AS (SELECT id, regexp_extract_all(lower(strip_accents(part)), '[\\p{L}\\p{N}_]{2,}') AS w FROM d UNION ALL SELECT -1, regexp_extract_all('the tion and ntble of thereon', '[\\p{L}\\p{N}_]{2,}')),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM g GROUP BY ALL),
v AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM tf WHERE id >= 0 GROUP BY term ORDER BY total DESC, term LIMIT 20000),
x AS (SELECT id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN v USING (term)),
u AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
s AS (SELECT a.id, round(least(1, greatest(-1, sum(a.w * b.w))), 6) AS score FROM u a JOIN u b USING (term) WHERE a.id >= 0 AND b.id = -1 GROUP BY a.id)
SELECT row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank, id, score AS semantic_score, (SELECT count(*) FROM s WHERE score >= 0.05) > 10 AS limited FROM s WHERE score >= 0.05 ORDER BY score DESC, id::VARCHAR LIMIT 10""")
def tfidf_search(spark, sf_dir):
    return search.search(benchmark(spark, sf_dir), ASKED, limit=10).select(F.col("rank").cast("long"), "id", "semantic_score", "limited")


@query()
def lsa_search(spark, sf_dir):
    return search.lsa_search(benchmark(spark, sf_dir), ASKED, limit=10)


@query("WITH q AS (SELECT list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END) AS q), s AS (SELECT vec_id AS id, round_even(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 6) AS score FROM embeddings, q) SELECT row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank, id, score FROM s ORDER BY score DESC, id::VARCHAR LIMIT 15")
def vector_search(spark, sf_dir):
    q = [1.0 if i % 2 == 0 else -0.5 for i in range(1, 65)]
    return search.vector_search(table(spark, sf_dir, "embeddings"), q, 15).select(F.col("rank").cast("long"), "id", "score")


@query("""WITH p AS (SELECT doc_id, list_slice(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), lambda x: length(x) > 15), 1, 300) AS l FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s, len(l)::DOUBLE AS n FROM p),
t AS (SELECT doc_id, i, n, unnest(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]{2,}')) AS term FROM e),
c AS (SELECT doc_id, i, n, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL),
f AS (SELECT *, ln((1 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1 AS idf FROM c),
u AS (SELECT *, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, i)) AS w FROM f),
m AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, term) / n AS m FROM u),
sc AS (SELECT doc_id, i, round(sum(w * m), 9) AS score FROM m GROUP BY ALL),
r AS (SELECT e.doc_id, e.i, e.s, row_number() OVER (PARTITION BY e.doc_id ORDER BY coalesce(score, 0) DESC, e.i) AS k FROM e LEFT JOIN sc ON sc.doc_id = e.doc_id AND sc.i = e.i)
SELECT d.doc_id, coalesce(string_agg(s, chr(10) ORDER BY i), '') AS summary FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k <= 3 GROUP BY d.doc_id""")
def summaries(spark, sf_dir):
    return search.summaries(documents(spark, sf_dir), 3)


@query()
def corpus_fingerprint(spark, sf_dir):
    return search.fingerprint(benchmark(spark, sf_dir))


# --- records -------------------------------------------------------------------------------

JOBS = "SELECT event_id, user_id, event_type, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'done' END AS status FROM events"


def job_events(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "click", "running").when(kind == "view", "queued").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.col("event_id").alias("seq"), F.lit("").alias("message"))


@query("SELECT event_id AS seq, user_id AS id, event_type FROM events ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id DESC LIMIT 12")
def jobs_recent(spark, sf_dir):
    return store.recent(job_events(spark, sf_dir), 12).select("seq", "id", "event_type")


@query(f"WITH j AS ({JOBS}), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT user_id AS id, status, event_id AS last_event FROM l")
def jobs_latest(spark, sf_dir):
    return store.latest(job_events(spark, sf_dir), "id").select("id", "status", F.col("seq").alias("last_event"))


@query(f"WITH j AS ({JOBS}), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT count(*) AS n_active FROM l WHERE status IN ('queued', 'running')")
def jobs_active(spark, sf_dir):
    return store.active(store.latest(job_events(spark, sf_dir), "id"))


@query(f"WITH j AS ({JOBS}), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT user_id AS id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status FROM l")
def jobs_interrupted(spark, sf_dir):
    return store.interrupted(store.latest(job_events(spark, sf_dir), "id")).select("id", "status")


@query("SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY event_type")
def settings_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return store.latest(rows, "key").select("key", "value")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS name, floor(o_totalprice)::BIGINT AS size, (o_custkey % 9)::BIGINT AS findings FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC LIMIT 100")
def scans_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    report = F.to_json(F.struct(F.col("o_orderpriority").alias("name"), F.lit(".txt").alias("format"), F.floor("o_totalprice").alias("size"), (F.col("o_custkey") % 9).alias("findings"), F.lit(True).alias("supported"), F.lit("text").alias("export_mode")))
    scans = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), report.alias("report"), F.lit(None).cast("string").alias("output"), F.col("o_orderkey").alias("seq"))
    return store.listing(scans).select("id", "name", "size", F.col("findings").cast("long"))


@query("SELECT p_name AS name, (p_partkey % 4 = 0) AS is_dir, p_partkey FROM part ORDER BY is_dir DESC, lower(p_name), p_name, p_partkey LIMIT 150")
def folder_listing(spark, sf_dir):
    # The order of rows of equal names goes by the key, so names are made to carry it.
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("\t"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("name"), (F.col("p_partkey") % 4 == 0).alias("is_dir"), "p_partkey")
    return files.listing(p, 150).select(F.substring_index("name", "\t", 1).alias("name"), "is_dir", "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS body FROM orders")
def uploads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    data = F.when(F.col("o_orderkey") % 7 == 0, "%%%").otherwise(F.base64(F.col("o_orderpriority").cast("binary")))
    return files.uploads(o, F.col("o_orderkey").cast("string"), data).select(F.col("path").cast("long").alias("o_orderkey"), F.col("content").cast("string").alias("body"))


@query(O.with_words("SELECT doc_id, page::BIGINT AS page, text, x0, x0 + 10 AS x1, y0, y0 + 20 AS y1, confidence FROM o WHERE is_ocr AND word_no % 7 <> 0"))
def ocr_tsv(spark, sf_dir):
    w = words(spark, sf_dir)
    s = lambda c: F.col(c).cast("string").alias
    rows = w.select(
        "doc_id", "page", F.when(F.col("word_no") % 7 == 0, "4").otherwise("5").alias("level"), F.concat(F.lit(" "), "text").alias("text"), s("x0")("left"), s("y0")("top"),
        F.lit("10").alias("width"), F.lit("20").alias("height"), F.coalesce(F.col("confidence").cast("string"), F.lit("n/a")).alias("conf"),
        F.lit("1").alias("block_num"), F.lit("1").alias("par_num"), F.col("line").cast("string").alias("line_num"),
    )
    return files.ocr_words(rows).select("doc_id", F.col("page").cast("long"), "text", "x0", "x1", "y0", "y1", "confidence")


# --- file bytes: made here, parsed by the sources ---------------------------------------------


def png(text: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"Comment\0" + text) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0" * 2)) + chunk(b"IEND", b"") + b"tail"


def files_of(key: int, name: str) -> dict[str, bytes]:
    """Small files of a supplier: an archive, images, Office documents and a text; every fifth archive lacks a member, every second card number is wrong."""
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as a:
        a.writestr("a.txt", f"Mail s{key}@example.org or x{key % 3}@example.org")
        if key % 5:
            a.writestr("b/unknown.bin", b"\x01\x02")
        a.writestr("../escape.txt", "no")
        a.writestr("pic.png", png(b"secret"))
    note = str(key).encode()
    cells = [("First", 1, 1, f"x{key}@example.org", False), ("First", 1, 2, str(key), True), ("First", 2, 1, "=cmd", False)]
    return {
        "zip": z.getvalue(),
        "png": png(b"hello" + note),
        "jpg": b"\xff\xd8\xff\xe1\x00\x08Exif\0\0\xff\xfe" + struct.pack(">H", 2 + len(note)) + note + b"\xff\xda\x00\x02",
        "docx": office.docx_file([(0, -1, -1, f"Name: {name}"), (1, 0, 0, f"a{key}@example.org"), (1, 0, 1, "b")]),
        "xlsx": office.xlsx_file(cells),
        "pptx": office.pptx_file([(1, -1, 0, 0, 7000000, 5000000, ""), (1, 0, key, 20, 300000, 5, f"Name: {name}\nto a{key}@example.org"), (2, -1, 0, 0, 0, 0, ""), *[(3, 0, 1, 2, 3, 4, "plain")] * (key % 2)]),
        "docm": marked(key),
        "txt": f"caf\u00e9 4111 1111 1111 111{1 + key % 2} of {key}".encode("cp1252"),
    }


def marked(key: int) -> bytes:
    """A document that holds more than its text: properties, a comment, an embedded object, links, changes, as many as its key says."""
    parts = {"word/document.xml": "<d>" + "<ins/>" * (key % 3) + "<del/>" * (key % 2) + "</d>", "docProps/core.xml": "<c/>"}
    if key % 4 == 0:
        parts |= {"word/comments.xml": "<c/>", "word/vbaProject.bin": ""}
    if key % 5 == 0:
        parts["word/_rels/document.xml.rels"] = "<r>" + '<x TargetMode="External"/>' * (key % 3 + 1) + "<x/></r>"
    return office.package(parts)


def sample_files(spark, sf_dir, *kinds: str) -> DataFrame:
    """(path, content): files of each supplier, made from its row."""

    def make(frames):
        for pdf in frames:
            rows = [(f"/in/{k}.{kind}", raw) for k, n in zip(pdf["s_suppkey"], pdf["s_name"], strict=True) for kind, raw in files_of(int(k), n).items() if kind in kinds]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInPandas(make, "path string, content binary")


SUPPLIER = "cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as s_suppkey"


@query("SELECT s_suppkey::BIGINT AS s_suppkey, name, supported, matches, metadata, note FROM supplier CROSS JOIN (VALUES ('a.txt', true, 2, 0, ''), ('b/unknown.bin', false, 0, 0, 'unsupported'), ('../escape.txt', false, 0, 0, 'unsafe_linked_or_encrypted'), ('pic.png', true, 0, 2, 'pixels_not_scanned')) t(name, supported, matches, metadata, note) WHERE s_suppkey % 5 > 0 OR name <> 'b/unknown.bin'")
def zip_members(spark, sf_dir):
    found = archives.analysed(archives.members(sample_files(spark, sf_dir, "zip")))
    return found.select(F.expr(SUPPLIER), "name", "supported", F.col("matches").cast("int"), F.col("metadata").cast("int"), "note")


@query("SELECT '/in/' || s_suppkey || '.zip' AS path, 4::BIGINT AS findings, true AS supported, CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 4 END::BIGINT AS n_members FROM supplier")
def zip_report(spark, sf_dir):
    return archives.archive_report(archives.analysed(archives.members(sample_files(spark, sf_dir, "zip"))))


@query("SELECT s_suppkey::BIGINT AS s_suppkey, name, body FROM supplier CROSS JOIN (VALUES ('document-001.txt', 'Mail [EMAIL_1] or [EMAIL_2]'), ('image-002.png', NULL), ('clean-copy-report.json', NULL)) t(name, body)")
def zip_clean(spark, sf_dir):
    clean = archives.clean_archives(archives.analysed(archives.members(sample_files(spark, sf_dir, "zip"))))
    again = archives.members(clean.select("path", F.col("clean").alias("content")))
    return again.select(F.expr(SUPPLIER), "name", F.when(F.col("name").like("%.txt"), F.col("data").cast("string")).alias("body"))


@query("SELECT s_suppkey::BIGINT AS s_suppkey, ordinal, type, size + CASE type WHEN 'tEXt' THEN length(s_suppkey::VARCHAR) ELSE 0 END AS size FROM supplier CROSS JOIN (VALUES (0, 'IHDR', 13::BIGINT), (1, 'tEXt', 13::BIGINT), (2, 'IDAT', NULL::BIGINT), (3, 'IEND', 0::BIGINT)) t(ordinal, type, size)")
def png_chunks(spark, sf_dir):
    rows = images.png_rows(sample_files(spark, sf_dir, "png"))
    return rows.select(F.expr(SUPPLIER), "ordinal", "type", F.when(F.col("type") != "IDAT", F.col("size")).alias("size"))


@query("SELECT s_suppkey::BIGINT AS s_suppkey, label, bytes + CASE WHEN label = 'tEXt image chunk' THEN length(s_suppkey::VARCHAR) ELSE 0 END AS bytes FROM supplier CROSS JOIN (VALUES ('tEXt image chunk', 13::BIGINT), ('Data after PNG end marker', 4::BIGINT)) t(label, bytes)")
def png_metadata(spark, sf_dir):
    out = sample_files(spark, sf_dir, "png").select("path", images.png_udf("content").alias("r"))
    return out.select(F.expr(SUPPLIER), F.explode("r.metadata").alias("m")).select("s_suppkey", "m.label", "m.bytes")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, label, bytes + CASE WHEN label = 'JPEG comment' THEN length(s_suppkey::VARCHAR) ELSE 0 END AS bytes FROM supplier CROSS JOIN (VALUES ('EXIF or XMP metadata', 8::BIGINT), ('JPEG comment', 2::BIGINT)) t(label, bytes)")
def jpeg_segments(spark, sf_dir):
    return images.jpeg_rows(sample_files(spark, sf_dir, "jpg")).select(F.expr(SUPPLIER), "label", "bytes")


@query("""SELECT '/in/' || s_suppkey || kind AS path, CASE kind WHEN '.docx' THEN 'Name: ' || s_name || chr(10) || 'a' || s_suppkey || '@example.org' || chr(10) || 'b'
    WHEN '.xlsx' THEN 'x' || s_suppkey || '@example.org' || chr(9) || s_suppkey || chr(10) || '=cmd' ELSE 'caf' || chr(233) || ' 4111 1111 1111 111' || (1 + s_suppkey % 2) || ' of ' || s_suppkey END AS text, method
  FROM supplier CROSS JOIN (VALUES ('.docx', 'Office XML'), ('.xlsx', 'Office XML'), ('.txt', 'Windows-1252')) t(kind, method)""")
def extract_text(spark, sf_dir):
    out = files.extracted(sample_files(spark, sf_dir, "docx", "xlsx", "txt", "png"))
    return out.where("text <> ''").select("path", "text", "method")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, block, \"row\", col, text, removed FROM supplier CROSS JOIN (VALUES (0, -1, -1, 'Name: [NAME_1]', 1), (1, 0, 0, '[EMAIL_1]', 1), (1, 0, 1, 'b', 0)) t(block, \"row\", col, text, removed)")
def docx_clean(spark, sf_dir):
    found = office.docx_fragments(sample_files(spark, sf_dir, "docx"))
    clean = office.clean_fragments(found)
    again = office.docx_fragments(office.rebuilt_docx(clean).select("path", F.col("clean").alias("content")))
    return again.join(clean.select("path", "block", "row", "col", "removed"), ["path", "block", "row", "col"]).select(F.expr(SUPPLIER), "block", "row", "col", "text", "removed")


@query("""SELECT s_suppkey::BIGINT AS s_suppkey, slide, shape, "left" + CASE WHEN slide = 1 AND shape = 0 THEN s_suppkey ELSE 0 END AS "left", top, width, height, text, removed FROM supplier
  CROSS JOIN (VALUES (1, -1, 0::BIGINT, 0::BIGINT, 7000000::BIGINT, 5000000::BIGINT, '', 0), (1, 0, 0, 20, 300000, 91440, 'Name: [NAME_1]' || chr(10) || 'to [EMAIL_1]', 2), (2, -1, 0, 0, 7000000, 5000000, '', 0), (3, -1, 0, 0, 7000000, 5000000, '', 0), (3, 0, 1, 2, 91440, 91440, 'plain', 0)) t(slide, shape, "left", top, width, height, text, removed)
  WHERE slide < 3 OR s_suppkey % 2 = 1""")
def pptx_clean(spark, sf_dir):
    clean = office.clean_fragments(office.pptx_fragments(sample_files(spark, sf_dir, "pptx")))
    again = office.pptx_fragments(office.rebuilt_pptx(clean).select("path", F.col("clean").alias("content")))
    removed = clean.select("path", "slide", "shape", "removed")
    return again.join(removed, ["path", "slide", "shape"]).select(F.expr(SUPPLIER), "slide", "shape", "left", "top", "width", "height", "text", "removed")


@query("""WITH s AS (SELECT s_suppkey::BIGINT AS s_suppkey FROM supplier), m AS (
  SELECT s_suppkey, 'metadata' AS category, 'Document properties: docProps/core.xml' AS label FROM s
  UNION ALL SELECT s_suppkey, 'comments', 'Comment part: word/comments.xml' FROM s WHERE s_suppkey % 4 = 0
  UNION ALL SELECT s_suppkey, 'embedded', 'Embedded object or macro part' FROM s WHERE s_suppkey % 4 = 0
  UNION ALL SELECT s_suppkey, 'external_links', (s_suppkey % 3 + 1) || ' external relationship(s) in word/_rels/document.xml.rels' FROM s WHERE s_suppkey % 5 = 0
  UNION ALL SELECT s_suppkey, 'revision', (s_suppkey % 3 + s_suppkey % 2) || ' tracked change element(s)' FROM s WHERE s_suppkey % 3 + s_suppkey % 2 > 0) SELECT * FROM m""")
def office_marks(spark, sf_dir):
    out = sample_files(spark, sf_dir, "docm").select("path", F.explode(office.metadata_udf(F.col("content"))).alias("m"))
    return out.select(F.expr(SUPPLIER), "m.category", "m.label")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, sheet_name, \"row\", col, CASE WHEN is_number THEN s_suppkey::VARCHAR ELSE value END AS value, is_number FROM supplier CROSS JOIN (VALUES ('Sheet 1', 1, 1, '[EMAIL_1]', false), ('Sheet 1', 1, 2, '', true), ('Sheet 1', 2, 1, chr(39) || '=cmd', false)) t(sheet_name, \"row\", col, value, is_number)")
def xlsx_clean(spark, sf_dir):
    cells = office.clean_cells(office.xlsx_cells(sample_files(spark, sf_dir, "xlsx")))
    again = office.xlsx_cells(office.rebuilt_xlsx(cells).select("path", F.col("clean").alias("content")))
    names = cells.select("path", "sheet_name", "row", "col")
    return again.join(names, ["path", "row", "col"]).select(F.expr(SUPPLIER), "sheet_name", "row", "col", "value", (F.col("data_type") == "n").alias("is_number"))


@query(f"WITH s AS ({PATHS}), n AS (SELECT p_partkey, p_partkey // 50 AS grp, p_partkey % 3 <> 1 AS ok, p_partkey % 3 = 2 AS pic FROM s) SELECT p_partkey, CASE WHEN pic THEN 'image-' ELSE 'document-' END || lpad(row_number() OVER (PARTITION BY grp ORDER BY p_partkey)::VARCHAR, 3, '0') || CASE WHEN pic THEN '.png' ELSE '.txt' END AS copy FROM n WHERE ok")
def generic_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 50).alias("path"), F.col("p_partkey").alias("ordinal"), (F.col("p_partkey") % 3 != 1).alias("supported"), F.when(F.col("p_partkey") % 3 == 2, F.lit("x")).alias("png"))
    return archives.generic_names(p).select("p_partkey", "copy")
