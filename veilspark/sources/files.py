"""Files and folders as rows, and texts out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalog import EXCLUDED, IMAGE_FORMATS, MAX_FILE_BYTES, MAX_FILES, MAX_TEXT, OFFICE_FORMATS, TEXT_FORMATS, InputError


def scan_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = EXCLUDED, limit: int = MAX_FILES, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, relative, length, modificationTime, content): regular files below a folder, without excluded ones.

    More than `limit` files are an error, not a shorter list. Larger files keep
    their row without content and get error too_large.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    relative = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), base, F.lit(""))
    out = files.withColumn("relative", relative).where(~T.excluded(F.col("relative"), patterns))
    if out.drop("content").limit(limit + 1).count() > limit:
        raise InputError(f"more than {limit} files")
    large = F.col("length") > max_bytes
    return out.select("path", "relative", "length", "modificationTime", F.when(~large, F.col("content")).alias("content"), F.when(large, "too_large").alias("error"))


def listing(files: DataFrame, limit: int = 1500) -> DataFrame:
    """Entries of a folder (name, is_dir): folders first, then by name whatever its case; hidden ones left out."""
    return files.where(~F.startswith("name", F.lit("."))).orderBy(F.desc("is_dir"), F.lower("name"), "name").limit(limit)


def extracted(files: DataFrame) -> DataFrame:
    """Files (path, content) with text, method, truncated, warnings and error."""
    from .office import text_udf

    ext = T.suffix(F.col("path"))
    plain = T.decoded(F.col("content"))
    out = files.withColumn("_ext", ext).withColumn("_plain", F.when(ext.isin(TEXT_FORMATS), plain))
    out = out.withColumn("_office", text_udf(F.when(ext.isin(OFFICE_FORMATS), F.col("content")), F.when(ext.isin(OFFICE_FORMATS), ext)))
    text = F.coalesce("_plain.text", "_office.text", F.when(F.col("_ext").isin(IMAGE_FORMATS), F.lit("")))
    method = F.coalesce("_plain.method", F.when(F.col("_office.text").isNotNull(), "Office XML"), F.when(F.col("_ext").isin(IMAGE_FORMATS), "Filename and metadata only"))
    error = F.coalesce("_plain.error", "_office.error", F.when(~F.col("_ext").isin(*TEXT_FORMATS, *OFFICE_FORMATS, *IMAGE_FORMATS), "unsupported"))
    notes = F.array_compact(F.array(F.when(F.col("_ext").isin(OFFICE_FORMATS), "objects_not_converted"), F.when(F.col("_ext").isin(IMAGE_FORMATS), "image_not_scanned")))
    return out.select(
        *files.columns,
        F.substring(text, 1, MAX_TEXT).alias("text"),
        method.alias("method"),
        F.coalesce(F.length(text) > MAX_TEXT, F.lit(False)).alias("truncated"),
        notes.alias("warnings"),
        error.alias("extract_error"),
    )


def uploads(df: DataFrame, name: Column, data: Column) -> DataFrame:
    """Base64 uploads as files: (path, content), names cleaned. Malformed data has null content."""
    return df.withColumn("_d", data).select(T.clean_name(name).alias("path"), F.expr("try_to_binary(_d, 'base64')").alias("content"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    if not 1 <= len(text) <= MAX_TEXT:
        raise InputError(f"a pasted text has 1 to {MAX_TEXT} characters")
    return spark.createDataFrame([(text,)], "text string")


def ocr_words(lines: DataFrame) -> DataFrame:
    """Words of recognition output rows (doc_id, page and the twelve columns of the TSV form, as strings).

    Only word rows with text and numeric boxes and confidence count.
    """
    num = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height", "conf")}
    ok = (F.col("level") == "5") & (T.stripped(F.col("text")) != "")
    for c in num.values():
        ok = ok & c.isNotNull()
    line = F.concat_ws(".", F.coalesce("block_num", F.lit("0")), F.coalesce("par_num", F.lit("0")), F.coalesce("line_num", F.lit("0")))
    return lines.where(ok).select(
        "doc_id", "page", T.stripped(F.col("text")).alias("text"), num["left"].alias("x0"), num["top"].alias("y0"),
        (num["left"] + num["width"]).alias("x1"), (num["top"] + num["height"]).alias("y1"), num["conf"].alias("confidence"), line.alias("line"), F.lit(True).alias("is_ocr"),
    )


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recognition output files, unquoted and tab-separated, with their header."""
    return spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: which optional libraries the driver has."""
    from importlib.util import find_spec

    names = {"images": "PIL", "pdf": "pypdf", "layout": "pdfplumber", "word": "docx", "sheets": "openpyxl", "slides": "pptx"}
    return spark.createDataFrame([tuple(find_spec(m) is not None for m in names.values())], ", ".join(f"{n} boolean" for n in names))
