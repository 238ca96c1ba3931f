"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint over its word shingles. Distinct
fingerprints are cut into tiles by their population count; tile pairs whose
counts differ by more than the radius cannot hold a link and are never made.
Inside a task, tiles are cut again by the population counts of four 16-bit
fields: the sum of the field differences bounds the distance from below, so
more tile pairs are skipped. What remains is compared in full: exclusive-or and
bit counts in numpy. A task returns a spanning forest of the links it found, so
a group of near copies costs rows in proportion to its members, and connected
components join the forests.

With a similarity asked for, a pair within the radius is a link only if the
texts' shingle sets agree as well: each text carries a one-permutation MinHash
sketch of BINS bins, and the share of equal bins must lie within two standard
errors of that similarity or above: an estimate.

With `exact`, a link is a pair whose sets of shingles have that Jaccard
similarity (of 64-bit shingle hashes); the radius plays no part, fingerprints are
taken over distinct shingles and are only returned. No such pair is lost:

1. Of the sets, in one order of all shingles, two with similarity s share k of
   the first n - ceil(s n) + k of their n shingles (Wang et al. 2012), so a text is
   entered under those; k is two, or a hundredth of the smaller set (`sharing`). Any order is complete; shingles that a
   sample of texts has several times go last, so that frequent passages make few
   pairs. Pairs that share one by chance, which grow with the square of the texts,
   go before anything of the texts is joined to them.
2. Texts of a shingle are first compared with the least of them alone, then, if
   still in different components, with each other. A pair passes if its sizes, the
   shingle's places and signatures of the sets allow the similarity: all bounds.
3. Texts that such candidates connect are compared in full. Large connected sets
   are compared in pairs of chunks, a forest a task, so a group costs no rows in
   its square.

Cost: copies of a text share one fingerprint, so they cost one row. Distinct
fingerprints are compared in pairs of tiles, which is quadratic work divided by
what the population counts skip; the tile size bounds a task's memory. With
`exact` the work grows with the number of texts and of pairs that share a rare
shingle.

Null and empty texts have fingerprint zero and link like any other; an empty
table has no components. A null id never becomes a component's name; a component
of null ids only has a null name. Rows that repeat, also under one id, share a
fingerprint and so a component. A shingle bit that is set in just half the
shingles is 0. Texts of any length are read whole, a block of shingles at a time.
Other columns do not matter, whatever they are called: a result has its own, or
(keep_first) the columns of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, carried, components, release, unpacked

#: Fingerprints of a tile, least and most; between them an eighth of all, so that small inputs still make some dozens of tasks.
TILES = (8_192, 262_144)
#: Bins of a sketch, four bytes each.
BINS = 32
EMPTY = 0xFFFFFFFF
#: Texts of a chunk whose shingle sets are compared in one task.
CHUNK = 256
#: Fingerprints of an inner tile.
INNER = 512
FIELDS = 4


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of `size` words, in order; fewer words are one shingle, none have none."""
    import xxhash

    xx, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: max(1, n - size + 1)].tolist()
    ends = ends[min(n, size) - 1 :].tolist() if n else []
    return np.fromiter((xx(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)), "<u8", len(starts))


def described(raw: bytes, size: int, bins: int = 0, once: bool = False) -> tuple[int, np.ndarray]:
    """Fingerprint of a text in UTF-8 (a bit is 1 if it is set in over half the shingle hashes; once: each different one counts once), and its sketch."""
    sketch = np.full(bins, EMPTY, np.uint32)
    words = raw.lower().split()  # bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return 0, sketch
    every = shingles(words, size)
    if once:
        every = np.unique(every)
    total = np.zeros(64, np.int64)
    for at in range(0, len(every), 32_768):
        h = every[at : at + 32_768]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
        if bins:
            np.minimum.at(sketch, (h % np.uint64(bins)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32))
    one = (total * 2 > len(every)).astype(np.uint8)
    return int(np.packbits(one, bitorder="little").view("<u8")[0]), sketch


def fingerprint(raw: bytes, size: int) -> int:
    return described(raw, size)[0]


def fingerprints(size: int = 4, bins: int = 0, once: bool = False):
    """UDF text as binary -> struct of the fingerprint, as a signed long, and the sketch (empty without bins)."""

    @F.pandas_udf("fp long, sketch binary")
    def fp(raw: pd.Series) -> pd.DataFrame:
        values = [described(x or b"", size, bins, once) for x in raw]
        release()
        return pd.DataFrame({"fp": np.array([v for v, _ in values], dtype=np.uint64).view(np.int64), "sketch": [k.tobytes() for _, k in values]})

    return fp


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of the shingle sets of rows of sketches; texts without shingles are alike."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    return np.where(n > 0, ((a == b) & some).sum(1) / np.maximum(n, 1), 1.0)


def least_share(similarity: float) -> float:
    return similarity - 2 * (similarity * (1 - similarity) / BINS) ** 0.5


class Forest:
    """Union-find over the fingerprints of a task, and the links that joined trees."""

    def __init__(self, n: int, sketches: np.ndarray | None = None, least: float = 0.0):
        self.root, self.links, self.sketches, self.least = np.arange(n), [], sketches, least

    def flat(self) -> None:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.sketches is not None:
            self.flat()
            new = self.root[i] != self.root[j]
            i, j = i[new], j[new]
            good = alike(self.sketches[i], self.sketches[j]) >= self.least
            i, j = i[good], j[good]
        while len(i):
            self.flat()
            a, b = self.root[i], self.root[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            # One link for each upper root at a time: hooks to lower roots make no cycle.
            _, first = np.unique(np.maximum(a, b), return_index=True)
            self.root[np.maximum(a, b)[first]] = np.minimum(a, b)[first]
            self.links += list(zip(i[first].tolist(), j[first].tolist(), strict=True))


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int, xs: np.ndarray | None = None, ys: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of fingerprints, of the links within x (y None) or between x and y; xs and ys are sketches."""

    def cut(v, sketches):
        counts = np.stack([np.bitwise_count((v >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(FIELDS)], 1).astype(np.int64)
        order = np.lexsort(counts.T[::-1])
        v, counts = v[order], counts[order]
        at = range(0, len(v), INNER)
        return v, sketches[order] if sketches is not None else None, [(i, counts[i : i + INNER].min(0), counts[i : i + INNER].max(0)) for i in at]

    x, xs, xt = cut(x, xs)
    if y is None:
        y, yt, off = x, xt, 0
    else:
        y, ys, yt = cut(y, ys)
        off = len(x)
    every = np.concatenate([x, y]) if off else x
    both = None if xs is None else np.concatenate([xs, ys]) if off else xs
    forest = Forest(len(every), both, least)
    low, high = np.array([t[1] for t in yt]), np.array([t[2] for t in yt])
    for n, (i, lo, hi) in enumerate(xt):
        gap = (np.maximum(0, low - hi) + np.maximum(0, lo - high)).sum(1)
        near = np.flatnonzero(gap <= radius)
        if not off:
            near = near[near >= n]
        a = x[i : i + INNER, None]
        for m in near.tolist():
            j = yt[m][0]
            found = np.bitwise_count(a ^ y[None, j : j + INNER]) <= radius
            if not off and j == i:
                found = np.triu(found, 1)
            if found.any():
                p, q = np.nonzero(found)
                forest.add(p + i, q + j + off)
    return [(int(every[p]), int(every[q])) for p, q in forest.links]


def links(fps: DataFrame, radius: int, stash: Stash, tile: int | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (fp, and sketch if a similarity is given), a forest a tile pair."""
    spark = fps.sparkSession
    # 65 rows at most: the number of fingerprints of each population count.
    have = {r[0]: r[1] for r in fps.groupBy(F.bit_count("fp").alias("p")).count().collect()}
    tile = tile or min(TILES[1], max(TILES[0], sum(have.values()) // 8))
    # Neighbouring counts share a class until a class fills a tile; a large count is dealt over several tiles.
    classes, lo, held = [], 0, 0
    for p in range(65):
        if held and held + have.get(p, 0) > tile:
            classes.append((lo, p - 1, held))
            lo, held = p, 0
        held += have.get(p, 0)
    classes.append((lo, 64, held))
    tiles = [(n, s, a, b, parts) for n, (a, b, size) in enumerate(classes) for parts in [max(1, -(-size // tile))] for s in range(parts)]
    number = {(t[0], t[1]): k for k, t in enumerate(tiles)}
    # Tile pairs by class: the partner classes of a class are fixed by the counts, so a row's partners are arithmetic.
    rows = [
        (a, parts, n, [number[m, 0] for m, (c, d, _) in enumerate(classes) if c - b <= radius and a - d <= radius], number[n, 0])
        for n, (a, b, size) in enumerate(classes)
        for parts in [max(1, -(-size // tile))]
    ]
    of_class = {n: (first, partners) for _, _, n, partners, first in rows}
    parts_of = {number[n, 0]: parts for _, parts, n, _, _ in rows}
    schema = "p int, first int, parts int, partners array<struct<first:int,parts:int>>"
    table = spark.createDataFrame(
        [(p, of_class[n][0], parts_of[of_class[n][0]], [(f, parts_of[f]) for f in of_class[n][1]]) for n, (a, b, _) in enumerate(classes) for p in range(a, b + 1)],
        schema,
    )
    own = ["fp", "sketch"] if similarity else ["fp"]
    dealt = fps.select(*own, F.bit_count("fp").alias("p")).join(F.broadcast(table), "p")
    dealt = dealt.select(*own, (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("t"), "partners")
    dealt = dealt.select(*own, "t", F.explode(F.flatten(F.transform("partners", lambda x: F.sequence(x["first"], x["first"] + x["parts"] - 1)))).alias("o"))
    dealt = dealt.select(*own, F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "t")

    least = least_share(similarity) if similarity else 0.0

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v, t, x, y = pdf["fp"].to_numpy().view(np.uint64), pdf["t"].to_numpy(), pdf["x"].iat[0], pdf["y"].iat[0]
        k = np.frombuffer(b"".join(pdf["sketch"]), "<u4").reshape(len(pdf), -1) if similarity else None
        side = lambda n: (v[t == n], None if k is None else k[t == n])
        if x == y:
            found = tile_links(v, None, radius, k, None, least)
        else:
            (a, ka), (b, kb) = side(x), side(y)
            found = tile_links(a, b, radius, ka, kb, least)
        out = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return stash.keep(dealt.groupBy("x", "y").applyInPandas(compare, "a long, b long"))


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """Different shingle hashes of a text in UTF-8, in order. A text without shingles has the set of zero alone, so such texts are alike."""
    words = (raw or b"").lower().split()
    return np.unique(shingles(words, size)) if words else np.zeros(1, "<u8")


#: Texts, about, whose shingles are counted to put frequent ones last, and how many of those are remembered. Any order is exact.
SAMPLED, FREQUENT = 20_000, 250_000
#: One of so many texts is sampled, at least: of a fixed number of texts, more and more shingles would be frequent and not known to be.
EVERY = 16
#: Shingles that two texts must share among their first ones: so many, or a hundredth of the smaller set if that is more; all of a set of fewer.
SHARED, SHARE = 2, 100
#: Bits of a set's signature, in integers of 64.
SIGNED = 16


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, how often) of shingles that several of a sample of different texts have; docs: (id, th, text)."""
    every = max(1, min(EVERY, docs.count() // SAMPLED))
    some = docs.where(F.pmod("th", F.lit(every)) == 0).select("th", F.col("text").cast("binary").alias("raw")).dropDuplicates(["th"])

    def cut(frames):
        for pdf in frames:
            found = [shingle_set(x, size) for x in pdf["raw"]]
            yield pd.DataFrame({"h": np.concatenate([*found, np.zeros(0, "<u8")]).view(np.int64)})
            release()

    seen = some.select("raw").mapInPandas(cut, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    top = seen.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    return top["h"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order]


def first_shingles(own: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a sorted set of which as many as `sharing` asks for are shared with every set of that similarity: the first by frequency, then hash."""
    hashes, times = known
    rank = np.zeros(len(own), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        rank = np.where(hashes[at] == own, times[at], 0)
    most = len(own) - math.ceil(similarity * len(own) - 1e-6) + max(SHARED, len(own) // SHARE)
    return own[np.argsort(rank, kind="stable")[:most]]


def signature(own: np.ndarray) -> np.ndarray:
    """SIGNED integers whose bits tell whether an odd number of the set's shingles fall on them: sets that differ in d shingles differ in d bits at most."""
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * SIGNED), minlength=64 * SIGNED) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def outlines(docs: DataFrame, size: int, similarity: float, named: bool) -> DataFrame:
    """(id, th, n, first, s0 ..., and fp if named) of (id, th, text): the number of different shingles, the first ones in order, and the signature."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))
    bits = [f"s{k}" for k in range(SIGNED)]

    @F.pandas_udf(f"n int, first array<long>, {', '.join(f'{c} long' for c in bits)}")
    def outline(raw: pd.Series) -> pd.DataFrame:
        found = [shingle_set(x, size) for x in raw]
        signed = np.array([signature(x) for x in found], np.int64).reshape(-1, SIGNED)
        out = {"n": np.array([len(x) for x in found], np.int32), "first": [first_shingles(x, held.value, similarity).view(np.int64) for x in found]}
        del found
        release()
        return pd.DataFrame(out | {c: signed[:, k] for k, c in enumerate(bits)})

    raw = F.col("text").cast("binary")
    fp = [fingerprints(size, once=True)(raw)["fp"].alias("fp")] if named else []
    return docs.select("id", "th", *fp, outline(raw).alias("o")).select("id", "th", *["fp"] * named, "o.*")


def sets_of(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep..., set) of rows with a text: its different shingle hashes, in order, as binary."""

    @F.pandas_udf("binary")
    def sets(raw: pd.Series) -> pd.Series:
        out = pd.Series([shingle_set(x, size).astype("<u8").tobytes() for x in raw])
        release()
        return out

    return rows.select(*keep, sets(F.col("text").cast("binary")).alias("set"))


def linked(pairs: DataFrame, docs: DataFrame, size: int, similarity: float, stash: Stash) -> DataFrame:
    """Those pairs (a, b) of text hashes whose shingle sets have that Jaccard similarity; docs: (id, th, text)."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return shared / (len(x) + len(y) - shared)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    sets = stash.keep(sets_of(docs.join(asked, "th", "left_semi").dropDuplicates(["th"]), size, "th"))
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("set").alias("y")), "b")
    out = stash.keep(both.where(jaccard("x", "y") >= similarity).select("a", "b"))
    stash.drop(sets)
    return out


def sharing(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b), each once, from a row for each shingle that both have among their first ones; n and m are the sizes, at the sum of the shingle's places. Pairs that share too few, or whose sizes or first shared shingle rule the similarity out, go."""
    n, m = F.col("n"), F.col("m")
    near = pairs.where(F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6)
    # A pair's sizes are the same in all its rows. What stands before the first shared shingle is not shared.
    both = near.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("at").alias("at"), F.min(F.least(n, m)).alias("least"), F.min(n + m).alias("sum"))
    return both.where((F.col("c") >= F.least("least", F.greatest(F.lit(SHARED), F.floor(F.col("least") / SHARE)))) & (F.col("at") <= F.col("sum") * (1 - similarity) / (1 + similarity) + 1e-6)).select("a", "b")


def candidates(docs: DataFrame, every: DataFrame, size: int, similarity: float, stash: Stash) -> DataFrame:
    """(node, root): components, by text hash, of links that connect all texts with that similarity; docs: (id, th, text), every: their `outlines`."""
    bits = [f"s{k}" for k in range(SIGNED)]
    # Shingles that one of two sets alone has, at most, as a share of both sizes.
    apart = F.lit((1 - similarity) / (1 + similarity))
    same = Window.partitionBy("key")
    each = every.select("th", "n", F.posexplode("first").alias("at", "key"))
    shared = each.select("*", F.min("th").over(same).alias("low"), F.max("th").over(same).alias("high")).where("low <> high")
    shared = stash.keep(shared.select("key", "th", "n", "at").distinct())
    # Of the texts that share shingles alone.
    signed = every.join(shared.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.min("n").alias("n"), *[F.min(c).alias(c) for c in bits])
    signed = stash.keep(signed)

    def passed(pairs: DataFrame) -> DataFrame:
        one = signed.select(F.col("th").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}_a") for c in bits])
        two = signed.select(F.col("th").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}_b") for c in bits])
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
        both = pairs.join(one, "a").join(two, "b")
        both = both.where(differ <= (F.col("na") + F.col("nb")) * apart + 1e-6)
        both = stash.keep(both.select("a", "b", (F.col("na") + F.col("nb") > 3 * 64 * SIGNED).alias("long")))
        long = linked(both.where("long").select("a", "b"), docs, size, similarity, stash)
        return both.where("not long").select("a", "b").unionByName(long)

    lead = shared.select("*", F.min(F.struct("th", "n")).over(same).alias("l")).where("th <> l.th")
    found = passed(sharing(lead.select(F.col("l.th").alias("a"), F.col("th").alias("b"), "n", F.col("l.n").alias("m"), F.lit(0).alias("at")), similarity))
    roots = components(found, stash)
    rest = shared.join(roots.select(F.col("node").alias("th"), "root"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    rest = rest.select("*", (F.min("root").over(same) != F.max("root").over(same)).alias("several")).where("several").drop("several")
    rest = stash.keep(rest)
    stash.drop(shared)
    other = rest.select("key", F.col("th").alias("b"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("root_b"))
    more = rest.join(other, "key").where("root < root_b")
    more = passed(sharing(more.select(F.least("th", "b").alias("a"), F.greatest("th", "b").alias("b"), "n", "m", (F.col("at") + F.col("to")).alias("at")), similarity))
    out = roots
    if more.limit(1).count():
        out = components(found.unionByName(more), stash)
    return out


def same_sets(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of places, of sorted sets whose Jaccard similarity is at least the one given; side None: all pairs, else pairs of different sides."""
    n = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    values, every = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root, out = np.zeros(len(values), bool), np.arange(len(sets)), []
    for i in range(len(sets)):
        with_ = (np.arange(len(sets)) < i) & (root != root[i]) & (np.minimum(n, n[i]) / np.maximum(n, n[i]) >= similarity)
        if side is not None:
            with_ &= side != side[i]
        if not with_.any():
            continue
        mine = every[at[i] : at[i] + n[i]]
        mark[mine] = True
        for j in np.flatnonzero(with_).tolist():
            if root[i] == root[j]:
                continue
            shared = np.count_nonzero(mark[every[at[j] : at[j] + n[j]]])
            if shared / (n[i] + n[j] - shared) >= similarity:
                out.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
        mark[mine] = False
    return out


def verified(docs: DataFrame, members: DataFrame, shingle: int, similarity: float, stash: Stash) -> DataFrame:
    """(a, b): links between texts, by hash, of one candidate component: forests of the pairs with that similarity.

    docs: (id, th, text); members: (comp, size, id, th), one row a text of a component of several texts.
    """

    asked = members.select("comp", "size", F.col("id").alias("i"), F.col("th").alias("h"))
    rows = docs.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).dropDuplicates(["th"])
    rows = stash.keep(sets_of(rows, shingle, "comp", "size", "th"))
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = rows.select("comp", "th", "set", F.pmod(F.xxhash64(F.lit(1), "th"), parts).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    dealt = dealt.select("comp", "th", "set", "c", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        th, c = pdf["th"].to_numpy(), pdf["c"].to_numpy()
        side = None if pdf["x"].iat[0] == pdf["y"].iat[0] else c
        found = np.array(same_sets([np.frombuffer(x, "<u8") for x in pdf["set"]], side, similarity), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": th[found[:, 0]], "b": th[found[:, 1]]})

    return stash.keep(dealt.groupBy("comp", "x", "y").applyInPandas(compare, "a long, b long"))


def alike_groups(docs: DataFrame, shingle: int, similarity: float, named: bool, stash: Stash) -> DataFrame:
    """(id, th, component_id, and fp if named) of each document (id, th, text), whose components are those of verified links."""
    every = stash.keep(outlines(docs, shingle, similarity, named))
    own = stash.keep(every.select("id", "th", *["fp"] * named))
    reps = stash.keep(own.groupBy("th").agg(F.min("id").alias("id")))
    roots = candidates(docs, every, shingle, similarity, stash)
    stash.clear(own, reps, roots)
    members = reps.join(roots.withColumnRenamed("node", "th"), "th").select("id", "th", F.col("root").alias("comp"))
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    members = stash.keep(members.join(sizes, "comp"))
    roots = components(verified(docs, members, shingle, similarity, stash), stash)
    of = reps.join(roots.withColumnRenamed("node", "th"), "th", "left").select("id", "th", F.coalesce("root", "th").alias("root"))
    of = stash.keep(of)
    stash.clear(own, of)
    names = of.groupBy("root").agg(F.min("id").alias("component_id"))
    return own.join(of.join(names, "root").select("th", "component_id"), "th")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, tile: int | None, similarity: float | None, exact: bool, named: bool = True) -> DataFrame:
    """(id, th, fp, component_id) of each document, with `exact` fp only if named; th is a hash of the whole text, which tells rows of equal ids apart."""
    stash = Stash(docs.sparkSession, "simhash")
    if exact:
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        return alike_groups(texts, shingle, similarity, named, stash)
    described_by = fingerprints(shingle, BINS if similarity else 0)(F.col(text_col).cast("binary"))
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), described_by.alias("d"))
    every = stash.keep(every.select("id", "th", "d.*"))
    least = every.groupBy("fp").agg(F.min("id").alias("least"), F.min("sketch").alias("sketch"))
    roots = components(links(least.select("fp", "sketch"), radius, stash, tile, similarity), stash)
    named = stash.keep(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return every.drop("sketch").join(named.join(names, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int | None = None, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """One row a document: its id, fingerprint (16 hex digits) and component_id, the least id it reaches over links."""
    found = grouped(docs, id_col, text_col, shingle, radius, tile, similarity, exact)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile: int | None = None, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """One document of each group: the one whose id names the component. Of equal rows one stays; rows with a null id all stay."""
    mark = len(Stash.live)
    found = grouped(docs, id_col, text_col, shingle, radius, tile, similarity, exact, named=False).where("id is not null")
    made = Stash.live[mark:]
    marks = found.groupBy("id", "th").agg((F.first("id") != F.first("component_id")).alias("gone"), (F.count("*") > 1).alias("again"))
    marks = Stash(docs.sparkSession, "simhash").keep(marks.where("gone or again"))
    for stash in made:
        stash.clear()
    rows = carried(docs, id=F.col(id_col), th=F.xxhash64(text_col))
    kept = rows.join(marks.where("gone").select("id", "th"), ["id", "th"], "left_anti")
    if marks.where("again and not gone").limit(1).count():
        twice = marks.where("again and not gone").select("id", "th")
        once = kept.join(twice, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        kept = kept.join(twice, ["id", "th"], "left_anti").unionByName(once)
    return kept.select(*unpacked(kept))
