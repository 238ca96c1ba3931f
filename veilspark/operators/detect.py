"""Detection, redaction and reports over DataFrames of texts.

Limits reject a row with an error code and leave the others alone; strict mode
fails the query instead. Null texts have no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.catalog import LABELS, MAX_CANDIDATES, MAX_TEXT


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column that is computed once. A generated column is not put in the place of its uses by the optimizer, which
    would repeat these long expressions in every filter and projection above."""
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def detect(df: DataFrame, text_col: str = "text", enabled: list[str] | None = None, literals: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows with `spans` (accepted findings, by start) and `error` (null, text_too_long or too_many_candidates)."""
    text = F.col(text_col)
    fits = F.when(F.length(text) <= MAX_TEXT, text)
    out = held(df, "_cands", S.candidates(fits, enabled, literals))
    error = F.when(F.length(text) > MAX_TEXT, "text_too_long").when(F.size("_cands") > MAX_CANDIDATES, "too_many_candidates")
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error))
    out = out.withColumn("error", error.cast("string"))
    return held(out, "spans", F.when(F.col("error").isNull(), S.resolved(F.col("_cands")))).drop("_cands")


def redact(df: DataFrame, text_col: str = "text", mode: str = "labels", name: str = "redacted") -> DataFrame:
    """Rows of `detect` with the redacted text; rejected rows have null."""
    return held(df, name, F.when(F.col("error").isNull(), S.redacted(F.coalesce(F.col(text_col), F.lit("")), F.col("spans"), mode)))


def findings(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a finding of `detect`'s rows: id, kind, start, end, value."""
    return df.select(id_col, F.explode("spans").alias("m")).select(id_col, "m.kind", "m.start", "m.end", "m.value")


def report(df: DataFrame, text_col: str = "text", metadata: Column | None = None) -> DataFrame:
    """Value-free report columns of `detect`'s rows: matches, counts, findings (matches and metadata items), text_length, truncated, status."""
    items = F.size(metadata) if metadata is not None else F.lit(0)
    return df.select(
        *[c for c in df.columns if c not in ("spans", text_col)],
        S.public(F.col("spans")).alias("matches"),
        S.counts(F.col("spans")).alias("counts"),
        (F.size("spans") + items).alias("findings"),
        F.length(text_col).alias("text_length"),
        F.when(F.col("error").isNull(), "review_required").otherwise("rejected").alias("status"),
    )


def counts_by_kind(df: DataFrame) -> DataFrame:
    """(kind, n) over all findings of `detect`'s rows, every kind with a row."""
    every = df.sparkSession.createDataFrame([(k,) for k in LABELS], "kind string")
    have = df.select(F.explode("spans.kind").alias("kind")).groupBy("kind").count()
    return every.join(F.broadcast(have), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("n"))


def stats(reports: DataFrame, limit: int = 100) -> DataFrame:
    """(files, findings, outputs) over the newest `limit` reports (created, seq, findings, output)."""
    newest = reports.orderBy(F.desc("created"), F.desc("seq")).limit(limit)
    return newest.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.coalesce("findings", F.lit(0))), F.lit(0)).alias("findings"), F.count_if(F.col("output").isNotNull()).alias("outputs"))


def export_report(reports: DataFrame) -> DataFrame:
    """A report without name, text, preview and members, but with the number of members."""
    out = reports.withColumn("member_count", F.size("members")) if "members" in reports.columns else reports
    return out.drop("name", "text", "preview", "members")


def clean(df: DataFrame, text_col: str = "text", mode: str = "labels", accept_partial: bool = False) -> DataFrame:
    """Clean copies and their audits of `detect`'s rows. A truncated source (column truncated, if any) is refused unless partial copies are accepted."""
    truncated = F.col("truncated") if "truncated" in df.columns else F.lit(False)
    ok = F.col("error").isNull() & (F.lit(accept_partial) | ~truncated)
    out = redact(df, text_col, mode, "_clean")
    audit = F.struct(
        F.size("spans").alias("removed_matches"),
        S.counts(F.col("spans")).alias("categories"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("source_sha256"),
        F.lit("UTF-8 plain text").alias("output_format"),
        truncated.alias("partial"),
        F.lit(False).alias("source_metadata_copied"),
    )
    return out.withColumn("clean", F.when(ok, F.col("_clean"))).withColumn("audit", F.when(ok, audit)).drop("_clean", "spans")


def unchanged(snapshot: DataFrame, current: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Rows of a scan snapshot (key, sha256) whose source still has that digest."""
    now = current.select(key, F.sha2(content, 256).alias("_now"))
    return snapshot.join(now, key).where(F.col("sha256") == F.col("_now")).drop("_now")


def cube_report(df: DataFrame, *dims: str) -> DataFrame:
    """Findings by every subset of the dimensions and kind; a null with its grouping bit set stands for all."""
    each = df.select(*dims, F.explode("spans.kind").alias("kind"))
    return each.cube(*dims, "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
