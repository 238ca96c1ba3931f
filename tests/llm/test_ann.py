"""Recall against brute force, and exact order of what is found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, q string"


def made(rng, n, dim, clusters):
    centres = rng.standard_normal((clusters, dim)) * 2
    return centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.3, 2, (n, 1))


@pytest.mark.parametrize(("n", "group"), [(3000, 100_000), (3000, 400), (30, 100_000)])
def test_recall_and_order(spark, n, group):
    rng = np.random.default_rng(n)
    x = made(rng, n, 24, 12).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[5]  # a third are copies of one vector
    rows = [(i, x[i].tolist(), "own") for i in range(n)]
    rows += [(90_000, None, ""), (90_020, [0.0] * 24, ""), (90_040, [float("nan")] * 24, ""), (90_060, [float("inf")] * 24, ""), (90_080, [], ""), (None, [1.0] * 24, ""), (90_100, [1.0, None], "")]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, group_rows=group).collect():
        got.setdefault(r.query_id, []).append(r)
    y = x.astype(float)
    hit = total = 0
    for q in range(0, n, 20):
        rs = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, min(20, n - 1) + 1))
        for r in rs:
            assert r.vec_id != q and abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 * max(1, abs(r.score))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        s = y @ y[q]
        s[q] = -np.inf
        best = np.sort(s)[::-1][: len(rs)]
        hit += sum(r.score >= best[-1] - 1e-9 for r in rs)
        total += len(rs)
    assert set(got) == set(range(0, n, 20)) and hit / total >= 0.9


def test_lengths_are_apart_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [1.0, 1.0], ""), (20, [1.0, 0.0, 0.0], "")], SCHEMA)
    got = [(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()]
    assert got == [(0, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_spans_are_prefix_matches():
    rng = np.random.default_rng(0)
    e = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    q = rng.integers(0, 2**64, 50, dtype=np.uint64)
    for length in (0, 1, 5, 64):
        lo, hi = ann.spans(e, q, length)
        for a, b, x in zip(lo, hi, q, strict=True):
            assert b - a == sum((int(v) ^ int(x)) >> (64 - length) == 0 for v in e)


def test_repeated_query_ids_and_single_scores(spark):
    """Of two vectors of one id the least by its bytes asks; a score is that of the pair alone."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 33))
    rows = [(i, x[i].tolist(), "") for i in range(60)] + [(20, x[41].tolist(), ""), (20, x[42].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string")
    least = min((x[20], x[41], x[42]), key=lambda v: v.astype("<f8").tobytes())
    for shuffled in (df, df.orderBy(F.rand(5))):
        got = {(r.query_id, r.vec_id): r.score for r in ann.search(shuffled, F.col("vec_id") % 20 == 0, k=70).collect()}
        assert all(got[20, i] == float(np.dot(least, x[i])) for i in range(60) if i != 20)
        assert all(got[0, i] == float(np.dot(x[0], x[i])) for i in range(1, 60) if i != 20)
