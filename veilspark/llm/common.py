"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of its own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/veilspark-shared"
    return root.rstrip("/")


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: an idle worker stands beside the executor of the next stage."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: hand them to Python a thousand at a time, unless the session already asks for fewer or others than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim_driver(spark: SparkSession, share: float = 0.75) -> bool:
    """Where the driver's heap takes that share of its limit, collect it, so that it shrinks and unused classes go: an operator of many small queries leaves plans, metrics and generated code behind, and the heap would grow to its limit beside what the driver needs outside of it."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= share * heap.maxMemory():
        return False
    jvm.java.lang.System.gc()
    return True


def carried(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows with all their columns in one struct, `row`, beside computed keys, so that no column of theirs clashes with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unpacked(rows: DataFrame, *leave: str, **replace: Column) -> list[Column]:
    """The columns of `row` again, some left out or replaced."""
    return [replace.get(c, F.col(f"row.`{c}`")).alias(c) for c in rows.schema["row"].dataType.names if c not in leave]


class Stash:
    """Intermediate tables of one operator call, in the shared folder.

    A written table cuts lineage and is reread by every later step, so a lost
    executor costs the tasks it was running and nothing else.
    """

    live: list[Stash] = []

    def __init__(self, spark: SparkSession, name: str):
        if not Stash.live:
            atexit.register(Stash.close_from, 0)
        Stash.live.append(self)
        self.spark = spark
        small_batches(spark)
        # Shuffle files go as soon as the table they made is written.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.root = f"{shared_dir(spark)}/stash-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.spark.sparkContext.master.startswith("local["):
            trim_driver(self.spark)
        return path

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            self.remove(path)

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables but those that the given frames read, once nothing else does: what stays takes disk until the whole call's results are written."""
        wanted = {p.rsplit("/", 2)[1] for df in but for p in df.inputFiles()}
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return
        for x in fs.listStatus(at):
            if x.getPath().getName() not in wanted:
                fs.delete(x.getPath(), True)

    @staticmethod
    def close_from(mark: int) -> None:
        """Delete what the stashes made since `mark` (a former len(Stash.live)) hold: once the results read from them are written. Also done at exit."""
        for stash in Stash.live[mark:]:
            try:
                stash.remove(stash.root)
            except Exception:  # the session may be gone, and its folder with it
                pass
        del Stash.live[mark:]

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, stash: Stash, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected graph; root is the least node it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the
    number of rounds grows with the logarithm of the longest path. Neighbour
    minima are combined before the shuffle, so a hub costs one row a task, and
    each round is a written table. Equal and self edges are allowed.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = stash.keep(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = stash.keep(small)
        # A forest of stars: every u has one v, and no v is a u.
        n, nu = new.agg(F.count("*"), F.count_distinct("u")).first()
        done = n == nu and not new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        stash.drop(e)
        e = new
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
