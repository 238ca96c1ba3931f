"""Scan and clean flows over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..functions.catalog import EXCLUDED, OFFICE_FORMATS
from ..operators.detect import clean, detect
from ..sources.files import extracted, scan_files
from ..sources.images import png_udf
from ..sources.office import metadata_udf

CAUTION = "Pattern checks can miss private information or mark harmless text. Review the result before sharing it."


def scan(spark: SparkSession, root: str, enabled: list[str] | None = None, literals: list[str] | None = None, patterns: tuple[str, ...] = EXCLUDED, include_text: bool = False) -> DataFrame:
    """A report of each file below a folder, by what its format allows; nothing private in it unless the text is asked for."""
    files = scan_files(spark, root, patterns)
    ext = T.suffix(F.col("path"))
    out = extracted(files).withColumn("format", ext)
    out = out.withColumn("route", T.route(F.col("format")))
    office = metadata_udf(F.when(F.col("format").isin(OFFICE_FORMATS), F.col("content")))
    png = png_udf(F.when(F.col("format") == ".png", F.col("content")))
    out = out.withColumn("_office", office).withColumn("_png", png)
    marks = F.transform("_png.metadata", lambda m: F.struct(F.lit("metadata").alias("category"), m["label"].alias("label")))
    out = out.withColumn("metadata", F.coalesce("_office", marks, F.array().cast("array<struct<category:string,label:string>>")))
    found = detect(out, "text", enabled, literals)
    keep = [F.col("text"), S.redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("preview")] if include_text else []
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "format",
        S.public(F.col("spans")).alias("matches"), S.counts(F.col("spans")).alias("counts"), "metadata", (F.size("spans") + F.size("metadata")).alias("findings"),
        F.length("text").alias("text_length"), "truncated", F.col("route.supported").alias("supported"), F.col("route.export_mode").alias("export_mode"),
        F.concat("warnings", F.array(F.lit(CAUTION))).alias("warnings"), F.coalesce("error", "extract_error").alias("error"),
        F.when(F.coalesce("error", "extract_error").isNull(), "review_required").otherwise("rejected").alias("status"), *keep,
    )


def clean_copies(spark: SparkSession, reports: DataFrame, enabled: list[str] | None = None, literals: list[str] | None = None, mode: str = "labels", accept_partial: bool = False) -> DataFrame:
    """(path, clean, audit, changed) of scanned text files, from their bytes as they are now.

    Findings are computed again with the scan's settings. A file that changed
    since its report (path, sha256) gets no copy.
    """
    paths = [r["path"] for r in reports.select("path").where("export_mode in ('text', 'office')").collect()]  # a scan's files, 20,000 at most
    if not paths:
        return spark.createDataFrame([], "path string, clean string, audit struct<removed_matches:int>, changed boolean")
    files = spark.read.format("binaryFile").load(paths)
    now = extracted(files).withColumn("_sha", F.sha2("content", 256)).join(reports.select("path", F.col("sha256").alias("_was")), "path")
    now = now.withColumn("changed", F.col("_sha") != F.col("_was"))
    out = clean(detect(now.drop("content"), "text", enabled, literals), "text", mode, accept_partial)
    return out.select("path", F.when(~F.col("changed"), F.col("clean")).alias("clean"), F.when(~F.col("changed"), F.col("audit")).alias("audit"), "changed")


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result where nothing is yet."""
    df.write.mode("errorifexists").format(fmt).save(path)
