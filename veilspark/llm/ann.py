"""Nearest neighbours by inner product with a hash-prefix forest.

Each tree is the sorted array of 64-bit hash strings of all vectors, one bit a
random hyperplane. A query descends in every tree to the entries that share the
longest prefix with its own string, and ascends in all trees together, a bit at
a time, until the trees hold the wanted number of candidates at that prefix
length. Candidates are scored exactly and the best are kept.

Inner products become angles by one more coordinate: sqrt(M^2 - |x|^2) for
rows, with M the largest norm, and 0 for queries.

Distribution: a tree's array is cut by the first bits of the string, so a group
is one stretch of one tree and holds the queries that meet it. First the groups
count, for each query, the entries at each prefix length; the sums give each
query's length; then the groups score those entries. Queries are rows like any
other and are never broadcast.

The wanted number of candidates is measured, not guessed: for a bounded sample
of queries the true neighbours are found by brute force, and the smallest number
is taken that finds RECALL of them. Data without structure needs a large share
of all rows, clustered data a small one.

Equal vectors are one row, with the k + 1 least ids of their class, which is all
that a result of k can show. Vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do null ids. Vectors of different
lengths are searched apart. Ties go to the smaller id; repeated ids are one row,
whose vector as a query is the least by its bytes, and which as a candidate
counts with its best. Scores of the result are computed anew for each pair, so a
pair's score does not depend on what was scored beside it. An empty table, or no
queries, gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

TREES = 16
BITS = 64
#: Rows of a group, on average.
GROUP_ROWS = 100_000
#: Queries whose true neighbours are found by brute force to set the number of candidates.
SAMPLE = 128
RECALL = 0.95
SEED = 11
#: Products scored in one numpy call.
BLOCK = 1 << 16


def planes(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, TREES * BITS))


def hashes(x: np.ndarray, extra: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(rows, TREES) unsigned hash strings; the first hyperplane is the highest bit."""
    signs = np.concatenate([x, extra[:, None]], axis=1) @ h > 0
    return np.packbits(signs.reshape(len(x), TREES, BITS), axis=2).view(">u8").astype(np.uint64)[:, :, 0]


def vectors(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)


def pack_udf():
    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<f8").tobytes() for v in x], dtype=object)

    return pack


def product_udf():
    """UDF of two packed vectors -> their inner product, each pair by itself."""

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8")) for x, y in zip(a, b, strict=True))
        return pd.Series([float(np.dot(x, y)) for x, y in pairs], dtype="float64")

    return product


def hash_udf(top: float, query: bool):
    """UDF packed vector -> its TREES strings, as longs in the order of the unsigned ones."""

    @F.pandas_udf("array<long>")
    def of(raw: pd.Series) -> pd.Series:
        out: list = [None] * len(raw)
        size = raw.map(len).to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            x = vectors([raw.iat[i] for i in at])
            extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))
            for i, h in zip(at, (hashes(x, extra, planes(n // 8)) ^ np.uint64(1 << 63)).view(np.int64), strict=True):
                out[i] = h
        return pd.Series(out, dtype=object)

    return of


def spans(entries: np.ndarray, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted entries those lie that share `length` first bits with each query."""
    rest = np.uint64((1 << (BITS - length)) - 1)
    return np.searchsorted(entries, q & ~rest, "left"), np.searchsorted(entries, q | rest, "right")


def unsigned(x: pd.Series) -> np.ndarray:
    return x.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)


def count_group(first: int):
    def count(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        q = unsigned(asked["h"])
        entries = np.sort(unsigned(data["h"])) if len(data) else np.empty(0, np.uint64)
        sums = [np.subtract(*spans(entries, q, n)[::-1]) if n >= first else np.zeros(len(q), int) for n in range(BITS + 1)]
        return pd.DataFrame({"q": asked["q"], "counts": pd.Series(list(np.array(sums, dtype=np.int64).T), index=asked.index, dtype=object)})

    return count


def score_group(k: int):
    def score(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        h = unsigned(data["h"])
        order = np.argsort(h, kind="stable")
        h, x, v = h[order], vectors(data["raw"].to_numpy())[order], data["v"].to_numpy()[order]
        y, q, level = vectors(asked["raw"].to_numpy()), unsigned(asked["h"]), asked["level"].to_numpy()
        lo, hi = np.zeros(len(q), int), np.zeros(len(q), int)
        for n in np.unique(level):
            at = level == n
            lo[at], hi[at] = spans(h, q[at], int(n))
        qs, vs, ss = [], [], []
        # Queries of one span share its product; a span is scored in blocks.
        for pair in np.unique(np.stack([lo, hi], 1), axis=0):
            a, b = int(pair[0]), int(pair[1])
            mine = np.flatnonzero((lo == a) & (hi == b))
            step = max(1, BLOCK // max(1, b - a))
            for m in range(0, len(mine) if b > a else 0, step):
                part = mine[m : m + step]
                s = y[part] @ x[a:b].T
                best = np.argpartition(-s, k - 1, axis=1)[:, :k] if b - a > k else np.broadcast_to(np.arange(b - a), s.shape)
                # All that equal the last of the best stay, so that ties are left to the ids.
                last = np.take_along_axis(s, best, 1).min(1)
                r, c = np.nonzero(s >= last[:, None])
                qs.append(asked["q"].to_numpy()[part[r]])
                vs.append(v[a + c])
                ss.append(s[r, c])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pd.DataFrame({"q": cat(qs, np.int64), "v": cat(vs, np.int64), "score": cat(ss, np.float64)})

    return score


def wanted(truth: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], recall: float) -> int:
    """The least number of candidates that finds the share `recall` of the true neighbours.

    truth: for each sample query its strings and those of its neighbours. A
    neighbour is found at every prefix length up to its longest over the trees.
    """
    longest = []
    for own, theirs in truth:
        differ = own[None, :] ^ theirs
        shared = np.full(differ.shape, BITS)
        some = differ > 0
        top = np.floor(np.log2(differ[some].astype(np.float64)))
        # log2 of a number just under a power of two may round up to it
        top = np.where(np.left_shift(np.uint64(1), np.minimum(top, 63).astype(np.uint64)) > differ[some], top - 1, top)
        shared[some] = BITS - 1 - np.minimum(top, 63).astype(int)
        longest.append(shared.max(1))
    sizes = np.unique(np.concatenate(counts))
    for m in sizes[np.unique(np.linspace(0, len(sizes) - 1, 400).astype(int))]:
        got = [(s >= level_of(c, m)).sum() for s, c in zip(longest, counts, strict=True)]
        if sum(got) >= recall * sum(map(len, longest)):
            return int(m)
    return int(sizes[-1])


def level_of(counts: np.ndarray, m: int) -> int:
    enough = np.flatnonzero(counts >= m)
    return int(enough[-1]) if len(enough) else 0


def search(table: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = RECALL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that `asked` (an expression over id_col) selects."""
    spark = table.sparkSession
    stash = Stash(spark, "ann")
    x = F.col("x")
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), asked.alias("asked"))
    finite = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    given = given.where("id is not null and x is not null and size(x) > 0").where(finite & F.exists(x, lambda a: a != 0))
    given = given.withColumn("raw", pack_udf()("x")).select("id", "raw", "asked", F.aggregate("x", F.lit(0.0), lambda s, a: s + a * a).alias("sq"))
    # A vector's class: two independent hashes of its bytes. The row limit acts before the shuffle, so a hot vector is cut to k + 1 rows a task.
    given = given.withColumn("v", F.xxhash64("raw")).withColumn("w", F.crc32("raw"))
    given = stash.keep(given)
    first = Window.partitionBy("v", "w").orderBy("id")
    members = given.select("v", "w", "id", "raw", "sq").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    members = stash.keep(members.dropDuplicates(["v", "w", "id"]))
    reps = members.where("n = 1").select("v", "raw", "sq")
    n, top = reps.agg(F.count("*"), F.sqrt(F.max("sq"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = given.where("asked").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("raw", "v")).alias("m")).select("query_id", F.col("m.v").alias("q"), "m.raw")
    distinct = queries.dropDuplicates(["q"]).select("q", "raw")
    if not distinct.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cut = max(0, (max(1, n // group_rows)).bit_length() - 1)  # first bits that name a group
    part = (F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), BITS - cut) if cut else F.lit(0).cast("long")).alias("part")
    tree = lambda df, query: df.select("*", F.posexplode(hash_udf(top, query)("raw")).alias("t", "h")).select("*", F.length("raw").alias("dim"), part)
    data = tree(reps.select("v", "raw"), False)
    probe = stash.keep(tree(distinct, True))
    keys = ["dim", "t", "part"]
    counts = data.select(*keys, "h").groupBy(*keys).cogroup(probe.select(*keys, "h", "q").groupBy(*keys)).applyInPandas(count_group(cut), "q long, counts array<long>")
    counts = stash.keep(counts.groupBy("q").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS + 1)]).alias("counts")))

    # A bounded sample of queries, their true neighbours, and how many candidates find them.
    sample = distinct.orderBy(F.xxhash64(F.lit(SEED), "q")).limit(SAMPLE).collect()
    known = {r["q"]: r["counts"] for r in counts.join(F.broadcast(spark.createDataFrame([(r["q"],) for r in sample], "q long")), "q").collect()}
    asked_raw = [(r["q"], bytes(r["raw"])) for r in sample]

    def brute(frames):
        for pdf in frames:
            size = pdf["raw"].map(len).to_numpy()
            for m in np.unique(size):
                mine = [(q, raw) for q, raw in asked_raw if len(raw) == m]
                if not mine:
                    continue
                held = pdf["raw"].to_numpy()[size == m]
                s = vectors([raw for _, raw in mine]) @ vectors(held).T
                best = np.argsort(-s, axis=1)[:, : k + 1]
                a = np.repeat(np.arange(len(mine)), best.shape[1])
                yield pd.DataFrame({"q": np.array([q for q, _ in mine])[a], "score": s[a, best.ravel()], "raw": held[best.ravel()]})

    near = reps.select("raw").mapInPandas(brute, "q long, score double, raw binary")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    truth: dict[int, list[bytes]] = {}
    for r in near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).collect():
        truth.setdefault(r["q"], []).append(bytes(r["raw"]))
    pairs, sums = [], []
    for q, raw in asked_raw:
        h = planes(len(raw) // 8)
        x, y = vectors([raw]), vectors(truth[q])
        far = np.sqrt(np.maximum(0.0, top * top - (y * y).sum(1)))
        pairs.append((hashes(x, np.zeros(1), h)[0], hashes(y, far, h)))
        sums.append(np.array(known[q], dtype=np.int64))
    m = wanted(pairs, sums, recall) if pairs else 1

    # The longest prefix with enough candidates; where even a whole group has too few, as many bits less as its density says.
    enough = F.expr(f"aggregate(sequence(0, {BITS}), -1, (a, i) -> if(counts[i] >= {m}, i, a))")
    less = F.greatest(F.lit(0), F.lit(cut) - F.ceil(F.log2(F.lit(float(m)) / F.greatest(F.col("counts")[cut], F.lit(1)))).cast("int"))
    level = F.when(enough >= cut, enough).otherwise(less).alias("level")
    probe = probe.join(counts.select("q", level), "q")
    spread = F.greatest(F.lit(0), F.lit(cut) - F.col("level"))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("part"), spread), spread)
    probe = probe.withColumn("part", F.explode(F.sequence(low, low + F.call_function("shiftleft", F.lit(1).cast("long"), spread) - 1)))
    out = stash.keep(nearest(data, probe, keys, members, queries, k))
    # Trees may hold the wanted number and yet, as they repeat entries, too few different ones: such queries see all of one tree.
    held = out.groupBy("query_id").agg(F.count("*").alias("n"))
    short = stash.keep(queries.join(held.where(F.col("n") >= k), "query_id", "left_anti"))
    if not short.limit(1).count():
        return out
    all_of = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << cut) - 1).cast("long"))).alias("part")
    again = probe.where("t = 0").drop("part", "level").distinct().join(short.select("q").distinct(), "q", "left_semi").select("*", F.lit(0).alias("level"), all_of)
    more = nearest(data.where("t = 0"), again, keys, members, short, k)
    return out.join(short.select("query_id"), "query_id", "left_anti").unionByName(more)


def nearest(data: DataFrame, probe: DataFrame, keys: list[str], members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the candidates that probes meet."""
    found = data.groupBy(*keys).cogroup(probe.groupBy(*keys)).applyInPandas(score_group(k + 1), "q long, v long, score double")
    found = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    # k + 1 classes hold the k nearest rows, whichever of them is the query itself.
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    cutoff = Window.partitionBy("q")
    found = found.withColumn("n", F.row_number().over(rank)).withColumn("last", F.min(F.when(F.col("n") <= k + 1, F.col("score"))).over(cutoff))
    # Block products round in their last digits; what is that close is scored again as well.
    found = found.where(F.col("score") >= F.col("last") - F.abs("last") * 1e-9)
    rows = found.join(members.select("v", "id", F.col("raw").alias("theirs")), "v").join(queries.select("q", "raw").dropDuplicates(["q"]), "q")
    rows = rows.select("q", "id", product_udf()("raw", "theirs").alias("score")).groupBy("q", "id").agg(F.max("score").alias("score"))
    near = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    out = queries.select("query_id", "q").join(near.select("q", "score", "id"), "q").where(F.col("id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
