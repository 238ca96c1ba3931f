"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a learned lexicon, its proximity to the
second person, and rates of capitals, punctuation and obfuscated spellings. The
lexicon, the trees and the calibration are fitted on a bounded sample of
labelled rows (MAX_TRAIN); the calibration has rows of its own. Every text is
scored in full, in one pass.

Null and empty texts are scored like any other, from zero features. Without
labelled rows of both classes every score is the share of label 1 (0 if there
are no labels); an empty table has no scores. Labels are taken per id: the
largest, nulls left out. Rows that repeat are scored each, and alike; those of a
labelled id are all learned from. Texts of any length, also of one word, are
read once, in time that grows with their length. Ties of scores share a pool of
the calibration. Other columns pass as they are, under any name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, carried, release, small_batches, unpacked

#: Labelled rows that the lexicon, the trees and the calibration see at most.
MAX_TRAIN = 12_000
#: Words of the lexicon.
LEXICON = 300
#: A lexicon word stands in at least so many labelled-toxic texts of the sample.
LEAST_TEXTS = 4

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = b"!?.,;:'\"()[]{}-_/\\*#$%&@^~|+=<>`"
#: A-Z to lower case, ASCII marks to spaces.
PLAIN = bytes(32 if b in MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Look-alikes of letters in obfuscated spellings.
ALIKE = bytes.maketrans(b"013457@$!|", b"oieastasil")
#: Fixed list: second-person words of the four languages of the tables.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes vosotros tus".encode().split())
#: Starts at the beginning of a run of letters and never goes back into one, so a long word is read once.
HIDDEN = re.compile(rb"(?<![A-Za-z])[A-Za-z]++[0-9@$!|*._-]++[A-Za-z][A-Za-z0-9@$!|*._-]*+")
DRAWN = re.compile(rb"([a-z])\1\1+")
NEAR = 4
FEATURES = 18


def plain_word(w: bytes) -> bytes:
    """An obfuscated spelling with look-alikes replaced, marks removed and drawn-out letters shortened."""
    w = w.lower().translate(ALIKE).translate(None, MARKS)
    return DRAWN.sub(rb"\1", w)


def features(raw: bytes, lexicon: dict[bytes, float]) -> list[float]:
    out = [0.0] * FEATURES
    n = len(raw)
    if not n:
        return out
    words = raw.translate(PLAIN).split()
    m = max(1, len(words))
    at = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in at]
    hidden = HIDDEN.findall(raw)
    masked = [x for x in map(plain_word, hidden) if x in lexicon]
    near = 0
    for i in at:
        if not YOU.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]):
            near += 1
    letters = n - len(raw.translate(None, LETTERS))
    capitals = n - len(raw.translate(None, UPPER))
    tokens = raw.split()
    shouted = sum(map(bytes.isupper, tokens)) if capitals > 0.2 * max(1, letters) else 0
    marks = n - len(raw.translate(None, MARKS))
    out[:] = [
        np.log1p(m),
        len(at) / m,
        np.log1p(len(at)),
        len({words[i] for i in at}),
        sum(weights) / m,
        sum(weights),
        max(weights, default=0.0),
        near / m,
        near,
        capitals / max(1, letters),
        shouted / m,
        marks / n,
        raw.count(b"!") / m,
        raw.count(b"?") / m,
        raw.count(b"!!") / m,
        len(hidden) / m,
        len(masked) / m,
        len(masked),
    ]
    return out


# --- gradient-boosted trees -------------------------------------------------


class Boosted:
    """Trees of logistic loss over quantile bins; a tree is arrays of feature, threshold, children and value."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0):
        self.shape = (trees, depth, rate, bins, ridge, least)
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        trees, depth, rate, bins, ridge, least = self.shape
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        cuts = [np.unique(np.concatenate([c, [x[:, k][x[:, k] > 0].min() / 2]])) if (x[:, k] > 0).any() else c for k, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
        width = bins + 2
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            nodes, where, at = [[-1, 0.0, 0, 0, 0.0]], np.zeros(len(y), int), [0]
            for level in range(depth + 1):
                new = []
                for node in at:
                    rows = np.flatnonzero(where == node)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    nodes[node][4] = float(rate * gs / (hs + ridge))
                    if level == depth or hs < 2 * least:
                        continue
                    best = (1e-6, 0, 0)
                    for k in range(x.shape[1]):
                        if not len(cuts[k]):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, k], g[rows], width))[: len(cuts[k])]
                        hl = np.cumsum(np.bincount(binned[rows, k], h[rows], width))[: len(cuts[k])]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least) | (hs - hl < least)] = -1
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (gain[b], k, b)
                    if best[0] > 1e-6:
                        _, k, b = best
                        left, right = len(nodes), len(nodes) + 1
                        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                        nodes[node][:4] = [k, float(cuts[k][b]), left, right]
                        where[rows] = np.where(binned[rows, k] <= b, left, right)
                        new += [left, right]
                at = new
            cols = list(zip(*nodes, strict=True))
            self.trees.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
            f += self.trees[-1][4][where]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.shape[1]):
                k = feature[node]
                go = np.where(x[rows, np.maximum(k, 0)] <= cut[node], left[node], right[node])
                node = np.where(k < 0, node, go)
            f += value[node]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y over f by pooling adjacent violators: knots and values."""
    order = np.argsort(f, kind="stable")
    knots, first = np.unique(f[order], return_index=True)
    sums, counts = np.add.reduceat(y[order], first), np.diff([*first, len(f)])
    pools: list[list[float]] = []
    for k, s, c in zip(knots, sums, counts, strict=True):
        pools.append([s, c, k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, hi = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += c2
            pools[-1][3] = hi
    # One pseudo-row spread over both classes keeps scores off 0 and 1.
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in [(p[0] + 0.5 * y.mean()) / (p[1] + 0.5)] * 2])
    keep = np.concatenate([[True], (np.diff(xs) > 0) | (np.diff(ys) > 0)])
    return xs[keep], np.maximum.accumulate(ys[keep])


class Model:
    """Lexicon, trees and calibration: a few hundred KB whatever the input."""

    def __init__(self, lexicon: dict[bytes, float], trees: Boosted | None, knots=(), values=(), share: float = 0.0):
        self.lexicon, self.trees, self.knots, self.values, self.share = lexicon, trees, knots, values, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0.0, 1.0)


def feature_udf(lexicon: dict[bytes, float]):
    @F.pandas_udf("array<double>")
    def of(raw: pd.Series) -> pd.Series:
        out = pd.Series([np.array(features(x or b"", lexicon)) for x in raw], dtype=object)
        release()
        return out

    return of


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the max_train labelled rows with the least hashed ids."""
    spark = docs.sparkSession
    stash = Stash(spark, "toxicity")
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    marked = marked.withColumn("h", F.xxhash64(F.lit("toxicity"), "_id")).orderBy("h").limit(max_train)
    # The sample is bounded by max_train rows, so it is broadcast and the texts stay where they are.
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("raw"))
    sample = stash.keep(text.join(F.broadcast(marked), "_id").withColumn("fold", F.pmod(F.col("h"), F.lit(4))))
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("y", F.col("fold") == 0).count().collect()}
    n, ones = sum(counts.values()), counts.get((1, False), 0) + counts.get((1, True), 0)
    if min(counts.get((y, f), 0) for y in (0, 1) for f in (False, True)) < 5:
        return Model({}, None, share=ones / n if n else 0.0)
    n1, n0 = counts[1, False], counts[0, False]
    lower = F.lower(F.col("raw").cast("string"))
    word = F.explode(F.array_distinct(F.split(lower, r"[^\p{L}]+")))
    seen = sample.where("fold <> 0").select("y", word.alias("w")).where("length(w) between 2 and 40").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n0 + 1))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    best = seen.where(F.col("a") >= LEAST_TEXTS).select("w", odds.alias("o"), (odds / spread).alias("z")).where("z > 3 and o > 1").orderBy(F.desc("z"), "w").limit(LEXICON)
    lexicon = {r["w"].encode(): float(r["o"]) for r in best.collect()}
    rows = sample.select(feature_udf(lexicon)("raw").alias("x"), "y", "fold").toArrow().to_pandas()  # max_train rows of FEATURES numbers
    x, y, held = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float), rows["fold"].to_numpy() == 0
    trees = Boosted().fit(x[~held], y[~held])
    knots, values = isotonic(trees.raw(x[held]), y[held])
    return Model(lexicon, trees, knots, values, ones / n)


def scorer(model: Model):
    """UDF text as binary -> score."""

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        x = np.array([features(t or b"", model.lexicon) for t in raw]).reshape(len(raw), FEATURES)
        release()
        return pd.Series(model.score(x), dtype="float64")

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Documents with a score (0 to 1) after their own columns; an own column of that name is left out."""
    small_batches(docs.sparkSession)
    out = carried(docs, score=scorer(model).asNondeterministic()(F.col(text_col).cast("binary")))
    return out.select(*unpacked(out, name), F.col("score").alias(name))


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """Documents that score under `limit`, with their own columns alone, whatever those are called."""
    small_batches(docs.sparkSession)
    out = carried(docs, score=scorer(model).asNondeterministic()(F.col(text_col).cast("binary")))
    return out.where(F.col("score") < limit).select(*unpacked(out))


def held_out(id_col: str | Column = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row's label or text must not be learned from. Null ids count as an empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts == part
