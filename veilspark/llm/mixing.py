"""Mixing sources to target weights, in DataFrame operations only.

Targets come from capped water-filling: every source gets a share of all words
in proportion to its weight; a source whose share exceeds the greatest number
of epochs over its own words is clamped there, and what it gives up goes to the
others by weight until none is above. The fixed point of that redistribution is
one water level: with sources in order of cap over weight, the level that the
first prefix of clamped sources leaves to the rest.

A document is taken a whole number of times, and once more for a seeded choice:
documents of a source in the order of a seeded hash, until the fractional rest
of its target is reached. The document that would pass it is left out, or with
`nearer` taken if that ends nearer to the target; the words taken are then within
half that document of it. The order is never sorted within one task: sums by
hash bucket find the bucket in which the rest runs out, and only that bucket is
ordered.

Null sources are a source of their own and come last. Null and empty texts have
size 0 and follow the same rules. No sources, or no words: all targets are 0.
Rows of one id, source and size are taken as often as each other, and copies
count with their words; equal hashes go by id, then size. Texts of any length are
one row that is counted whole. Columns of any other name come out as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, carried, n_words_of, unpacked

#: Fixed by the contract: weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17
#: Hash buckets of a source, as hex digits of the seeded hash: 16 ** 3.
BUCKET_DIGITS = 3


def water_level(sizes: DataFrame, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) -> the same with target.

    Rows are sources, which are ordered in one window as the level depends on
    all of them; they are sums over documents, one row a source.
    """
    caps = sizes.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    total = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # With sources in order of cap over weight, the first that its level does not fill is where clamping ends.
    found = caps.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    found = found.withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(total)["level"])
    return found.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with rank, weight and target. Strings are ordered by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    return water_level(sizes.withColumn("rank", rank).withColumn("weight", weight), max_epochs)


def seeded(id_col: Column, seed: int) -> Column:
    """A hash of a row's id as 32 hex digits; null ids hash as an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, stash: Stash | None = None, nearer: bool = False) -> DataFrame:
    """One row a document: (id, source, size, source_size, target, times)."""
    stash = stash or Stash(docs.sparkSession, "mixing")
    every = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"))
    every = stash.keep(every.withColumn("h", seeded(F.col("id"), seed)))
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    by_bucket = stash.keep(every.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = stash.keep(goal.select("source", "source_size", "target", "whole", "rest"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    cut = cut.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # 2: all of the bucket is within the rest, 1: the rest runs out in it
    cut = cut.select("source", "bucket", "source_size", "target", "whole", "rest", "before", F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0).alias("state"))
    # At most sources x 16 ** 3 rows; Spark broadcasts them while they are small and else joins by source and bucket, which the buckets spread.
    cut = cut.withColumnsRenamed({"source": "s", "bucket": "b"})
    mine = every.withColumn("bucket", bucket)
    mine = mine.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    clear = mine.where("state <> 1").withColumn("extra", F.when(F.col("state") == 2, 1).otherwise(0))
    edge = mine.where("state = 1")
    # Rows of equal id and size stand or fall together.
    run = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("before") + F.sum("size").over(run)
    within = after <= F.col("rest")
    if nearer:
        # The rows that cross: none of them, or all, whichever leaves less.
        own = F.sum("size").over(Window.partitionBy("source", "bucket", "h", "id", "size"))
        within = within | (after - own < F.col("rest")) & (after - F.col("rest") < F.col("rest") - (after - own))
    edge = edge.withColumn("extra", F.when(within, 1).otherwise(0))
    # A whole further repetition would pass the epochs only if the rest were as large as the source, which it is not.
    both = clear.unionByName(edge)
    return both.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("times"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they are."""
    reps = repetitions(docs, id_col, text_col, source_col, **params)
    # The number of times of a row depends on its id, source and size alone.
    reps = reps.groupBy("id", "source", "size").agg(F.max("times").alias("_times")).withColumnsRenamed({"id": "_i", "source": "_s", "size": "_n"})
    own = carried(docs, id=F.col(id_col), source=F.col(source_col), size=n_words_of(F.col(text_col)))
    on = F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    out = own.join(reps.where("_times > 0"), on).select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("again"))
    return out.select(*unpacked(out))
