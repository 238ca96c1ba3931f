"""Scores against a recursive reading of context-tree weighting."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from veilspark.llm import ctw, toxicity

TEXTS = ["the cat sat on the mat", "the cat  ate A rat", "a Rat sat", None, "", "dog! dög ate the cat", "the dog sat on a mat mat mat", "zebra the cat"] * 2


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(t):
    return (t or "").encode().lower().split()


def sequence(t):
    return b"\n" * ctw.DEPTH + b" ".join(tokens(t)) + b"\n"


def slow_scores(rows):
    counts = defaultdict(lambda: [0, 0])
    words = Counter()
    for i, t in rows:
        if held(i):
            continue
        words.update([*tokens(t), b"\n"])
        s = sequence(t)
        for p in range(ctw.DEPTH, len(s)):
            for d in range(ctw.DEPTH + 1):
                for k in range(8):
                    counts[s[p - d : p], (s[p] >> (8 - k)) | (1 << k)][(s[p] >> (7 - k)) & 1] += 1
    below = defaultdict(list)
    for c, x in counts:
        if c:
            below[c[1:], x].append((c, x))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(node):
        own = kt(*counts[node])
        if len(node[0]) == ctw.DEPTH:
            return own
        rest = sum(weighted(k) for k in below[node])
        m = max(own, rest)
        return m + math.log(math.exp(own - m) + math.exp(rest - m)) - math.log(2)

    def p_bit(s, p, k, d):
        node, bit = (s[p - d : p], (s[p] >> (8 - k)) | (1 << k)), (s[p] >> (7 - k)) & 1
        if node not in counts:
            return 0.5
        own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
        if d == ctw.DEPTH:
            return own
        w = math.exp(kt(*counts[node]) - math.log(2) - weighted(node))
        return w * own + (1 - w) * p_bit(s, p, k, d + 1)

    n, v, out = sum(words.values()), len(words), []
    for i, t in rows:
        s, tt = sequence(t), [*tokens(t), b"\n"]
        score = sum(math.log10(p_bit(s, p, k, 0)) for p in range(ctw.DEPTH, len(s)) for k in range(8))
        out.append((i, held(i), len(tt), sum(words[w] > 0 for w in tt), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tt), score))
    return out


@pytest.mark.parametrize(("strings", "words", "chunk"), [(10**6, 10**6, ctw.CHUNK), (40, 5, ctw.CHUNK), (10**6, 10**6, 7)])
def test_against_recursion(spark, monkeypatch, strings, words, chunk):
    monkeypatch.setattr(ctw, "CHUNK", chunk)
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, bits string")
    got = sorted(map(tuple, ctw.scored(df, toxicity.held_out(parts=7), max_strings=strings, max_words=words).collect()))
    for g, w in zip(got, slow_scores(rows), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_probabilities_of_a_context_add_up():
    import numpy as np

    rng = np.random.default_rng(0)
    seen = np.unique(rng.integers(0, 256, (500, ctw.DEPTH + 1)) % 5 + 97, axis=0)
    s = np.array([int.from_bytes(bytes(r.tolist()), "big") for r in seen], np.uint64)
    n = rng.integers(1, 50, len(s))
    levels, below = {}, None
    for d in range(ctw.DEPTH, -1, -1):
        levels[d] = ctw.Level(d, s, n)
        levels[d].weigh(below)
        below = levels[d].upward() if d else None
    for context in (s[0] >> np.uint64(8), np.uint64(0x6162636465), np.uint64(0)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp2(ctw.code(every, levels)).sum() == pytest.approx(1)


def test_better_than_single_words(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    out = ctw.scored(docs, toxicity.held_out(parts=7)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > out.b


def test_edges(spark):
    df = spark.createDataFrame([(2, None), (2, None), (None, "x y"), (9, "w" * 300_000)], "doc_id long, text string")
    assert ctw.scored(df, toxicity.held_out(parts=7)).count() == 4
    assert ctw.scored(df.limit(0), toxicity.held_out(parts=7)).count() == 0
    from pyspark.sql import functions as F

    r = ctw.scored(df.where("doc_id is null"), F.lit(True)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-8 * 4 * math.log10(2))
