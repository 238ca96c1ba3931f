"""Targets and choices against a plain loop."""

import pytest

from veilspark.llm import mixing


def slow_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = total - sum(cap * sizes[s] for s in clamped)
        out = {s: cap * sizes[s] if s in clamped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if out[s] > cap * sizes[s] + 1e-9]
        if not over:
            return out
        clamped |= set(over)


def rows_of(sizes, per=40):
    out, i = [], 0
    for s, words in sizes.items():
        for k in range(per):
            n = words // per + (k < words % per)
            out.append((i, " ".join(["w"] * n) if n else None, s))
            i += 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 4000, "b": 50, "c": 3000, None: 700}, {"z": 10, "é": 5000, "Z": 200}, {"only": 77}, {"a": 1, "b": 1, "c": 100_000}])
def test_targets_and_words_taken(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.repetitions(df).collect()
    assert len(got) == len(rows)
    want = slow_targets(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    for s, words in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {words}
        assert mine[0].target == pytest.approx(want[s])
        taken = sum(r.times * r.size for r in mine)
        assert 0 <= want[s] - taken < max(r.size for r in mine) + 1e-6
        assert max(r.times for r in mine) <= 3
    assert sorted(map(tuple, mixing.repetitions(df).collect())) == sorted(map(tuple, got))


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5), (2, "c", "y", 6), (2, "c", "y", 6), (None, "d d", None, 7), (3, None, "x", 8)], "doc_id long, text string, source string, _times int")
    times = {}
    for r in mixing.repetitions(df).collect():
        times[r.id, r.source] = r.times
    out = mixing.mixed(df)
    assert out.columns == df.columns
    from collections import Counter

    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert got == {k: n * (2 if k[0] == 2 else 1) for k, n in times.items() if n}


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.repetitions(df).count() == 0 and mixing.mixed(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], df.schema)
    assert [(r.target, r.times) for r in mixing.repetitions(blank).collect()] == [(0.0, 0)] * 2


def test_nearer_side_of_the_crossing_document(spark):
    """A long document early in the order does not leave a source far under its target."""
    sizes = {f"s{i}": [400, 30, 20, 10, 5, 3, 50, 7] for i in range(9)}
    rows = [(100 * k + n, " ".join(["w"] * size), s) for k, (s, every) in enumerate(sizes.items()) for n, size in enumerate(every)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain, near = ({(r.source, r.id): r for r in mixing.repetitions(df, nearer=x).collect()} for x in (False, True))
    off = lambda got, s: abs(sum(r.times * r.size for r in got.values() if r.source == s) - next(r.target for r in got.values() if r.source == s))
    assert all(off(near, s) <= off(plain, s) for s in sizes) and any(off(near, s) < off(plain, s) for s in sizes)
    assert all(off(near, s) <= 200 for s in sizes) and max(r.times for r in near.values()) <= 3
