"""What has to hold before a copy leaves: second views of a page, turned pages, masks that are missing, places that are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import _normal
from . import fuzzy
from .detect import detect

DOC = "doc_id"
#: The turns a page is read again at, in order, and how many such readings a document gets.
TURNS = (90, 180, 270)
MOST_TURNS = 6


def blanks_joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def second_views(words: DataFrame, chars: DataFrame) -> DataFrame:
    """(doc_id, page, flow): pages whose characters in their own order (doc_id, page, ordinal, text) read other than their words by place; blanks do not count."""
    joined = lambda df, at, between: df.groupBy(DOC, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "text"))), lambda x: x["text"]), between).alias("t"))
    flow = joined(chars, "ordinal", "").withColumnRenamed("t", "flow")
    both = flow.join(joined(words, "word_no", " "), [DOC, "page"], "left")
    return both.where("flow <> ''").where(blanks_joined(F.col("flow")) != blanks_joined(F.coalesce("t", F.lit("")))).select(DOC, "page", "flow")


def turned_pages(hits: DataFrame) -> DataFrame:
    """(doc_id, page, angle, unresolved) of each page (doc_id, page, angles): the turn that finds a value, and whether none did.

    angles: at which turns a reading of the page finds one, 0 for as it is. A page
    that finds none as it is gets the turns in order; a document gets MOST_TURNS
    readings in all, spent on its pages in order.
    """
    needed = F.when(F.array_contains("angles", 0), 0)
    for n, angle in enumerate(TURNS, 1):
        needed = needed.when(F.array_contains("angles", angle), n)
    needed = needed.otherwise(len(TURNS) + 1)
    out = hits.withColumn("_n", needed)
    spent = F.coalesce(F.sum(F.least("_n", F.lit(len(TURNS)))).over(Window.partitionBy(DOC).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    good = (F.col("_n") <= len(TURNS)) & ((F.col("_n") == 0) | (spent + F.col("_n") <= MOST_TURNS))
    angle = F.when(good, F.element_at(F.array(F.lit(0), *map(F.lit, TURNS)), F.col("_n") + 1))
    return out.select(DOC, "page", angle.alias("angle"), (~good).alias("unresolved"))


def without_masks(matches: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, error) of images that have findings but no rectangle to cover them."""
    return matches.select(DOC).distinct().join(regions.select(DOC).distinct(), DOC, "left_anti").withColumn("error", F.lit("regions_required"))


def painted(matches: DataFrame, regions: DataFrame, selected: DataFrame) -> DataFrame:
    """(doc_id, removed_matches, selected_regions, painted_regions): what a masked copy's audit counts."""
    n = lambda df, name: df.groupBy(DOC).agg(F.count("*").alias(name))
    out = n(matches, "removed_matches").join(n(selected, "selected_regions"), DOC, "full").join(n(regions, "automatic"), DOC, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(DOC, zero("removed_matches").alias("removed_matches"), zero("selected_regions").alias("selected_regions"), (zero("automatic") + zero("selected_regions")).alias("painted_regions"))


def recognised(texts: DataFrame, words: DataFrame, run_words: DataFrame, literals: list[str], ocr: bool, enabled: list[str] | None = None, unresolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings by place and reviews with warnings: exact and near where text was recognised, exact alone and nothing to review where it was not."""
    docs = detect(texts, enabled=enabled, literals=literals)
    custom = enabled is None or "custom" in enabled
    near = fuzzy.matches(docs, words, literals if ocr and custom else [], run_words)
    reviews = fuzzy.review(docs, run_words, literals if ocr and custom else [], unresolved if ocr else None)
    return fuzzy.all_matches(docs, near), fuzzy.warnings(reviews)


def within(path: Column, root: Column) -> Column:
    """Whether a path, with its steps up and doubled slashes resolved, is a folder or lies in it."""

    def resolved(p: Column) -> Column:
        steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
        up = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
        return F.concat(F.lit("/"), F.array_join(up, "/"))

    p, r = resolved(path), resolved(root)
    return (p == r) | (r == "/") | F.startswith(p, F.concat(r, F.lit("/")))


def output_name(label: Column, key: Column) -> Column:
    """Folder of a result: its label, and twelve hex digits of a key that is the run's own."""
    return F.concat(label, F.lit("-"), F.left(F.sha2(key.cast("string"), 256), F.lit(12)))


def examples(files: DataFrame, left_out: str = "README.txt") -> DataFrame:
    """Paths of the files of an example folder (path, is_dir), in order, one name left out."""
    return files.where(~F.col("is_dir") & (F.element_at(F.split("path", "/"), -1) != left_out)).select("path").orderBy("path")


def register(spark: SparkSession) -> list[str]:
    """Names under which SQL text can call the normal form of values and the card check from now on."""
    spark.udf.register("veil_normal", F.pandas_udf(_normal, "string"))
    digits = "regexp_replace(v, '[^0-9]', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION veil_card(v STRING) RETURNS BOOLEAN RETURN length({digits}) BETWEEN 13 AND 19 AND NOT {digits} RLIKE '^(.)\\\\1*$' AND luhn_check({digits})")
    return ["veil_normal", "veil_card"]
