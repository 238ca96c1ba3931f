"""Records of scans, jobs and settings.

Plain files cannot be updated, so changes are appended as events and read as
"the latest of each key". An event's seq orders events of one time stamp.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCANS = "id string, path string, created string, report string, settings string, output string, seq long"
JOBS = "id string, kind string, status string, created string, finished string, progress int, message string, result string, error string, seq long"
SETTINGS = "key string, value string, seq long"
ACTIVE = ("queued", "running")


def latest(events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The newest event of each key. Combined before the shuffle, so a key's history does not meet in one task."""
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in events.columns if c != key])
    best = events.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), F.to_json(row).alias("_j"))).alias("b"))
    schema = events.drop(key).schema
    return best.select(key, F.from_json("b._j", schema).alias("r")).select(key, *[f"r.{c}" for c in events.columns if c != key])


def recent(events: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The newest rows by created, then seq."""
    return events.orderBy(F.desc("created"), F.desc("seq"), *keys).limit(limit)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE)).agg(F.count("*").alias("n_active"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs as they are after a restart: what was waiting or running was interrupted."""
    hit = F.col("status").isin(*ACTIVE)
    return jobs.withColumn("message", F.when(hit, "Interrupted").otherwise(F.col("message"))).withColumn("status", F.when(hit, "interrupted").otherwise(F.col("status")))


def listing(scans: DataFrame, limit: int = 100) -> DataFrame:
    """Newest scans with fields of their report as columns."""
    report = F.from_json("report", "name string, format string, size long, findings int, supported boolean, export_mode string, status string")
    top = recent(scans, limit)
    return top.select("id", "path", "created", report.alias("r"), "output").select("id", "path", "created", "r.*", "output")


class Store:
    """Event tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def events(self, table: str) -> DataFrame:
        schema = {"scans": SCANS, "jobs": JOBS, "settings": SETTINGS}[table]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def create(self) -> None:
        for name, schema in (("scans", SCANS), ("jobs", JOBS), ("settings", SETTINGS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")

    def append(self, table: str, rows: DataFrame) -> None:
        have = self.events(table)
        rows.select(*have.columns).write.mode("append").parquet(f"{self.root}/{table}")

    def add_scans(self, reports: DataFrame, settings: str) -> None:
        """reports: path, created, report (struct). Ids derive from path and time."""
        seq = F.unix_micros(F.current_timestamp())
        ident = F.sha2(F.concat_ws("|", "path", "created", F.lit(uuid.uuid4().hex)), 256)
        self.append("scans", reports.select(ident.alias("id"), "path", "created", F.to_json("report").alias("report"), F.lit(settings).alias("settings"), F.lit(None).cast("string").alias("output"), seq.alias("seq")))

    def set_output(self, scan_id: str, output: str) -> None:
        row = self.get("scans", "id", scan_id)
        self.append("scans", row.withColumn("output", F.lit(output)).withColumn("seq", F.unix_micros(F.current_timestamp())))

    def table(self, name: str) -> DataFrame:
        return latest(self.events(name), "key" if name == "settings" else "id")

    def get(self, table: str, key: str, value: str) -> DataFrame:
        return latest(self.events(table).where(F.col(key) == value), key)

    def put_setting(self, key: str, value: str) -> None:
        self.append("settings", self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("seq", F.unix_micros(F.current_timestamp())))

    def job_event(self, **fields) -> None:
        cols = [c.split()[0] for c in JOBS.split(", ")]
        row = self.spark.createDataFrame([tuple(fields.get(c) for c in cols)], JOBS)
        self.append("jobs", row.withColumn("seq", F.unix_micros(F.current_timestamp())))

    def recover(self) -> None:
        """Append what a restart means for jobs that were waiting or running."""
        held = self.table("jobs").where(F.col("status").isin(*ACTIVE))
        self.append("jobs", interrupted(held).withColumn("seq", F.unix_micros(F.current_timestamp())))

    def compact(self, table: str) -> DataFrame:
        return self.table(table)
