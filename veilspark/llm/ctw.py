"""Language-model scores by context-tree weighting over bytes.

A text is the sequence of its words, A-Z lower-cased, joined by single spaces,
and one end byte. Each byte is eight binary decisions, the first of them that
of the highest bit; each decision, named by the bits before it, has a tree of
its own whose nodes are the 0 to DEPTH bytes before. A node keeps how often its
decision was 0 and 1 in the training texts (Krichevsky-Trofimov estimate); the
weighting mixes a node's own estimate and that of its children by how well
either coded the training texts, so all depths take part. The code length of a
byte is the sum of eight decisions.

All counts follow from those of byte strings of DEPTH + 1 bytes, which every
training text adds to. The trees are built in buckets by the two bytes nearest
to the coded one: a bucket holds whole subtrees, and what lies above them is at
most 65,536 contexts, summed on the driver. Strings seen in training get their
code length from a broadcast table of MAX_STRINGS at most; more strings are dealt
over several passes of the texts, whole buckets at a time (a single bucket above
that size is a pass of its own). Strings unseen in training, few by nature, are
collected per text and computed in those buckets of the pass that are asked for.

The base score is a unigram model with one added to each count. Its frequent
words (MAX_WORDS at most) are broadcast, all others are joined.

Null and empty texts have the end alone; an empty table has no scores. Without
training texts the score is that of a fair coin for each bit. Texts of any length
are read whole, in chunks. Rows that repeat are learned from and scored each, and
alike; words of equal counts at the limit of frequent ones go together. Other
columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash

DEPTH = 5
END = b"\n"
#: Strings with a code length that a Python worker holds at a time, 16 bytes each, in a table of half that load.
MAX_STRINGS = 4_000_000
#: Words with a count that a Python worker holds at a time.
MAX_WORDS = 250_000
#: Bytes of text that numpy works on at a time.
CHUNK = 3_000_000
#: Strings that a counting task holds before it hands them on.
HELD = 3_000_000
LN2 = math.log(2.0)


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def pieces(texts: list[list[bytes]]):
    """(text numbers, buffer, starts, sizes) of chunks: each piece stands behind DEPTH bytes of context."""
    held, size = [], 0
    for k, words in enumerate(texts):
        whole = END * DEPTH + b" ".join(words) + END
        for at in range(0, len(whole) - DEPTH, CHUNK):
            part = whole[at : at + CHUNK + DEPTH]
            held.append((k, part))
            size += len(part)
            if size >= CHUNK:
                yield packed(held)
                held, size = [], 0
    if held:
        yield packed(held)


def packed(held):
    of = np.array([k for k, _ in held])
    sizes = np.array([len(p) - DEPTH for _, p in held])
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    return of, np.frombuffer(b"".join(p for _, p in held), np.uint8), starts, sizes


def strings(buffer: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each byte from the DEPTH-th on, first byte highest."""
    x = buffer.astype(np.uint64)
    m = len(x) - DEPTH
    out = np.zeros(m, np.uint64)
    for i in range(DEPTH + 1):
        out = (out << np.uint64(8)) | x[i : i + m]
    return out


def inside(starts: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Which strings end in a piece and not in the context of the next."""
    step = np.zeros(m + DEPTH + 1, np.int8)
    step[starts] += 1
    step[starts + sizes] -= 1
    return np.cumsum(step[:m]).astype(bool)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, int)
    return k[first], np.add.reduceat(c[order], first) if len(first) else c


def count_strings(frames):
    keys, counts, held = [], [], 0
    for pdf in frames:
        for _, buffer, starts, sizes in pieces([tokens(x) for x in pdf["raw"]]):
            s = strings(buffer)
            k, c = np.unique(s[inside(starts, sizes, len(s))], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 2 * HELD:
                k, c = merged(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > HELD:
                    yield pd.DataFrame({"s": k.view(np.int64), "n": c})
                    keys, counts, held = [], [], 0
    if keys:
        k, c = merged(keys, counts)
        yield pd.DataFrame({"s": k.view(np.int64), "n": c})


def count_words(frames):
    held: Counter = Counter()
    for pdf in frames:
        for raw in pdf["raw"]:
            held.update(tokens(raw))
            held[END] += 1
            if len(held) > HELD // 4:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
    yield pd.DataFrame({"word": list(held), "n": list(held.values())})


# --- context trees ------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma by Stirling's series, eight places further on."""
    y = x + 8
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth, by (context bytes, bits so far): counts, own weight and weighted probability."""

    def __init__(self, depth: int, s: np.ndarray, n: np.ndarray):
        self.depth = depth
        ids, zeros, ones = [], [], []
        for k in range(8):
            node, bit = nodes(s, depth, k)
            ids.append(node)
            ones.append(np.where(bit, n, 0))
            zeros.append(np.where(bit, 0, n))
        key = np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.key = key[first]
        self.zeros = np.add.reduceat(np.concatenate(zeros)[order], first).astype(float)
        self.ones = np.add.reduceat(np.concatenate(ones)[order], first).astype(float)

    def weigh(self, below: tuple[np.ndarray, np.ndarray] | None) -> None:
        """below: parent nodes of the next depth's nodes, and the sums of their weighted probabilities' logarithms; None at the greatest depth."""
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.log_p, self.weight = own, np.ones(len(own))
            return
        children = np.zeros(len(own))
        children[np.searchsorted(self.key, below[0])] = below[1]
        self.log_p = np.logaddexp(own, children) - LN2
        self.weight = np.exp(own - LN2 - self.log_p)

    def upward(self) -> tuple[np.ndarray, np.ndarray]:
        """Parents (the oldest byte left out) and sums over their children."""
        up = parents(self.key, self.depth)
        order = np.argsort(up, kind="stable")
        up = up[order]
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        return up[first], np.add.reduceat(self.log_p[order], first)


def nodes(s: np.ndarray, depth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of decision k of each string at a depth, and the decision."""
    byte = s & np.uint64(255)
    context = (s >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    bits = (byte >> np.uint64(8 - k)) | np.uint64(1 << k)
    return (context << np.uint64(8)) | bits, ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)


def parents(key: np.ndarray, depth: int) -> np.ndarray:
    return key & np.uint64((1 << (8 * depth)) - 1)


TOP = 2  # depths 0 .. TOP - 1 are common to all buckets


def grow(s: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """Levels TOP .. DEPTH of the strings of a bucket, weighed."""
    levels, below = {}, None
    for depth in range(DEPTH, TOP - 1, -1):
        levels[depth] = Level(depth, s, n)
        levels[depth].weigh(below)
        below = levels[depth].upward()
    return levels


def code(s: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log2 probability of the last byte of each string. A node that is not there has seen nothing: one half."""
    out = np.zeros(len(s))
    for k in range(8):
        p = np.full(len(s), 0.5)
        for depth in range(DEPTH, -1, -1):
            level = levels[depth]
            if not len(level.key):
                continue
            node, bit = nodes(s, depth, k)
            at = np.minimum(np.searchsorted(level.key, node), len(level.key) - 1)
            there = level.key[at] == node
            own = (np.where(bit, level.ones[at], level.zeros[at]) + 0.5) / (level.zeros[at] + level.ones[at] + 1.0)
            p = np.where(there, level.weight[at] * own + (1 - level.weight[at]) * p, 0.5)
        out += np.log2(p)
    return out


class Table:
    """Open addressing from strings to code lengths, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, np.float32)
        at, live = self.slot(keys), np.arange(len(keys))
        while len(live):
            free = self.keys[at[live]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[live[free]]] = keys[live[free]]
            won = self.keys[at[live]] == keys[live]
            self.values[at[live[won]]] = values[live[won]]
            live = live[~won]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of keys that are not there."""
        at = self.slot(keys)
        found = self.keys[at]
        out = self.values[at].astype(np.float64)
        live = np.flatnonzero(found != keys)
        missing = []
        while len(live):
            gone = self.keys[at[live]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            missing.append(live[gone])
            out[live[gone]] = 0.0
            live = live[~gone]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[live]] == keys[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit]
        return out, np.concatenate(missing) if missing else np.empty(0, np.int64)


def bucket_of(s: np.ndarray, buckets: int) -> np.ndarray:
    """By the two bytes before the last; as bucket_col."""
    return ((s >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65521) % np.uint64(buckets)


def bucket_col(s: Column, buckets: int) -> Column:
    two = F.call_function("shiftright", s, F.lit(8)).bitwiseAND(F.lit(0xFFFF))
    return (two * 40503 % 65521 % buckets).cast("int")


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", max_strings: int = MAX_STRINGS, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities; texts with held_out are not learned from."""
    spark = docs.sparkSession
    stash = Stash(spark, "ctw")
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"), held_out.alias("held"))
    train = every.where(~F.col("held")).select("raw")
    strings_seen = stash.keep(train.mapInPandas(count_strings, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    words = stash.keep(train.mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = math.log10(total + distinct + 1)
    least = frequent_from(words, max_words)
    frequent = words.where(F.col("n") >= least).toArrow()  # max_words at most
    common = {w: math.log10(n + 1) for w, n in zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True)}
    common = spark.sparkContext.broadcast(common)

    n_strings = strings_seen.count()
    buckets = max(8, -(-n_strings // 200_000))
    dealt = strings_seen.withColumn("bucket", bucket_col(F.col("s"), buckets))
    top = spark.sparkContext.broadcast(summit(dealt))

    def known(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["s"].to_numpy().view(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"], "s": pdf["s"], "v": code(s, grow(s, pdf["n"].to_numpy()) | top.value)})

    def unknown(seen: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        s = seen["s"].to_numpy().view(np.uint64)
        below = grow(s, seen["n"].to_numpy()) if len(seen) else dict.fromkeys(range(TOP, DEPTH + 1), EMPTY)
        return pd.DataFrame({"s": asked["s"], "v": code(asked["s"].to_numpy().view(np.uint64), below | top.value)})

    codes = stash.keep(dealt.groupBy("bucket").applyInPandas(known, "bucket int, s long, v double"))
    turns = turns_of({r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}, buckets, max_strings)
    passes = int(turns.max()) + 1
    # 65,521 rows at most: which pass a bucket belongs to.
    turn_of = spark.createDataFrame([(b, int(t)) for b, t in enumerate(turns)], "bucket int, turn int")
    dealt = dealt.join(F.broadcast(turn_of), "bucket") if passes > 1 else dealt.withColumn("turn", F.lit(0))
    codes = codes.join(F.broadcast(turn_of), "bucket") if passes > 1 else codes.withColumn("turn", F.lit(0))
    out = None
    for turn in range(passes):
        mine = codes.where(F.col("turn") == turn).select("s", F.col("v").cast("float")).toArrow()  # max_strings at most, or one bucket
        table = spark.sparkContext.broadcast((mine["s"].to_numpy().view(np.uint64), mine["v"].to_numpy()))
        del mine
        one = score_udf(common if turn == 0 else None, table, turns, turn).asNondeterministic()
        part = every.select("id", "held", F.xxhash64("raw").alias("th"), one("raw").alias("r")).select("id", "held", "th", "r.*")
        part = stash.keep(part.withColumn("uid", F.monotonically_increasing_id()))
        lost = part.select("uid", F.explode("unseen").alias("s"))
        fresh = lost.select("s").distinct().withColumn("bucket", bucket_col(F.col("s"), buckets))
        # Trees grow only for buckets of this pass that a string asks for.
        seen = dealt.where(F.col("turn") == turn).drop("turn").join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")
        fresh = seen.select("s", "n", "bucket").groupBy("bucket").cogroup(fresh.groupBy("bucket")).applyInPandas(unknown, "s long, v double")
        extra = lost.join(stash.keep(fresh), "s").groupBy("uid").agg(F.sum("v").alias("more"))
        part = part.join(extra, "uid", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0))).drop("unseen", "more")
        if out is None:
            rare = part.select("uid", F.explode("rare").alias("word")).join(words.where(F.col("n") < least), "word")
            rare = rare.groupBy("uid").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_base"))
            out = part.drop("rare").join(rare, "uid", "left")
        else:
            rest = part.groupBy("id", "th").agg(F.max("bits").alias("b2")).withColumnsRenamed({"id": "i2", "th": "t2"})
            out = out.join(rest, F.col("id").eqNullSafe(F.col("i2")) & F.col("th").eqNullSafe(F.col("t2")), "left").withColumn("bits", F.col("bits") + F.col("b2")).drop("i2", "t2", "b2")
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("bits") * F.lit(math.log10(2))).alias("score"),
    )


class _Empty:
    key = np.empty(0, np.uint64)


EMPTY = _Empty()


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count that `most` words at most reach. Counts are added up by their size in steps of a tenth."""
    step = F.floor(F.log("n") / math.log(1.1)).cast("int")
    sums, held, least = words.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect(), 0, None  # about 450 rows for any 64-bit count
    for r in sums:
        held += r["count"]
        if held > most:
            break
        least = r["k"]
    if least is None:
        return 1 << 62
    n = max(1, int(1.1**least) - 1)
    while math.floor(math.log(n) / math.log(1.1)) < least:
        n += 1
    return n


def summit(dealt: DataFrame) -> dict[int, Level]:
    """Levels 0 .. TOP - 1, from sums over buckets: counts of (context byte, byte), and weighted probabilities of the subtrees."""

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n = pdf["s"].to_numpy().view(np.uint64), pdf["n"].to_numpy()
        up, log_p = grow(s, n)[TOP].upward()
        short, sums = merged([s & np.uint64((1 << (8 * TOP)) - 1)], [n])
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(short), len(up)]), "key": np.concatenate([short, up]).view(np.int64), "x": np.concatenate([sums.astype(float), log_p])})

    # 65,536 strings of two bytes and 65,280 nodes at most, whatever the corpus.
    rows = dealt.groupBy("bucket").applyInPandas(roots, "kind int, key long, x double").groupBy("kind", "key").agg(F.sum("x").alias("x")).toArrow().to_pandas().sort_values("key")
    two, up = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    if not len(two):
        return dict.fromkeys(range(TOP), EMPTY)
    s, n = two["key"].to_numpy().astype(np.uint64), two["x"].to_numpy()
    levels: dict[int, Level] = {}
    below = (up["key"].to_numpy().astype(np.uint64), up["x"].to_numpy())
    for depth in range(TOP - 1, -1, -1):
        levels[depth] = Level(depth, s, n)
        levels[depth].weigh(below)
        below = levels[depth].upward()
    return levels


#: The table of the model and pass that a Python worker scores with.
_TABLES: dict[str, Table] = {}


def turns_of(counts: dict[int, int], buckets: int, most: int) -> np.ndarray:
    """The pass of each bucket: passes hold `most` strings at most, or a single larger bucket."""
    out, loads = np.zeros(buckets, np.int32), [0]
    for b, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        t = next((t for t, held in enumerate(loads) if not held or held + n <= most), len(loads))
        if t == len(loads):
            loads.append(0)
        loads[t] += n
        out[b] = t
    return out


def score_udf(common, table, turns: np.ndarray, turn: int):
    """UDF text as binary -> what this pass adds: sums over seen strings, unseen strings, and (first pass) token counts and rare words."""
    name = uuid.uuid4().hex
    several = len(turns) > 0 and int(turns.max()) > 0

    @F.pandas_udf("n_tokens long, n_known long, base double, rare array<binary>, bits double, unseen array<long>")
    def score(raw: pd.Series) -> pd.DataFrame:
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Table(*table.value)
        codes = _TABLES[name]
        texts = [tokens(x) for x in raw]
        bits, unseen = np.zeros(len(texts)), [[] for _ in texts]
        for of, buffer, starts, sizes in pieces(texts):
            s = strings(buffer)
            v, missing = codes.get(s)
            use = inside(starts, sizes, len(s))
            if several:
                use &= turns[bucket_of(s, len(turns)).astype(np.int64)] == turn
            v[~use] = 0.0
            np.add.at(bits, of, np.add.reduceat(v, starts))
            missing = missing[use[missing]]
            if len(missing):
                for k, x in zip(of[np.searchsorted(starts, missing, side="right") - 1].tolist(), s[missing].view(np.int64).tolist(), strict=True):
                    unseen[k].append(x)
        rows = {"n_tokens": [len(w) + 1 for w in texts]}
        if common is None:
            rows |= {"n_known": 0, "base": 0.0, "rare": [[] for _ in texts]}
        else:
            get = common.value.get
            found = [[get(w) for w in (*words, END)] for words in texts]
            rows["n_known"] = [len(f) - f.count(None) for f in found]
            rows["base"] = [math.fsum(x for x in f if x is not None) for f in found]
            rows["rare"] = [[w for w, x in zip((*words, END), f, strict=True) if x is None] if None in f else [] for words, f in zip(texts, found, strict=True)]
        return pd.DataFrame(rows | {"bits": bits, "unseen": unseen})

    return score
