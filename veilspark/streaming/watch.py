"""Detection on streams. All detection is one row in, one row out, so batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import spans as S
from ..operators.detect import detect


def redacted_stream(texts: DataFrame, text_col: str = "text", enabled: list[str] | None = None, literals: list[str] | None = None, mode: str = "labels") -> DataFrame:
    """A stream of texts with redacted text and counts, without values."""
    found = detect(texts, text_col, enabled, literals)
    return found.withColumn("redacted", S.redacted(F.coalesce(F.col(text_col), F.lit("")), F.col("spans"), mode)).withColumn("counts", S.counts(F.col("spans"))).drop("spans", text_col)


def windowed_counts(texts: DataFrame, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, kind, n) of findings by event time; later rows than the watermark allows are left out."""
    found = detect(texts.withWatermark(time_col, late), text_col).select(time_col, F.explode("spans.kind").alias("kind"))
    return found.groupBy(F.window(time_col, window).alias("window"), "kind").agg(F.count("*").alias("n"))


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, enabled: list[str] | None = None, literals: list[str] | None = None) -> StreamingQuery:
    """Scan files of a folder as they arrive: value-free reports are appended to `out`, each file once across restarts.

    Plain text files; a trigger of all that is there, so that it runs as a job or under a scheduler.
    """
    from ..functions import text as T

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.withColumn("_d", T.decoded(F.col("content"))).select("path", "length", F.sha2("content", 256).alias("sha256"), F.col("_d.text").alias("text"), F.col("_d.error").alias("read_error"))
    found = detect(rows, "text", enabled, literals)
    report = found.select("path", "length", "sha256", "read_error", "error", S.public(F.col("spans")).alias("matches"), S.counts(F.col("spans")).alias("counts"), F.size("spans").alias("findings"))
    return report.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
