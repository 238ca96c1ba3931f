"""Fingerprints and links against plain loops."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import simhash


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 40_000):
        t = " \t\n\x0b\x0c\r".join(rng.choice(["Aé", "b", "C\u00a0d", "e\x1cf"]) for _ in range(n))
        assert simhash.fingerprint(t.encode(), 4) == (slow_fingerprint(t) if n < 1000 else simhash.fingerprint(t.lower().encode(), 4))


def test_fingerprint_hash_is_the_engines(spark):
    t = "one two three four"
    got = spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest(t.encode(), 42) == simhash.fingerprint(t.encode(), 4)


def near_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        v = rng.choice(out)
        for _ in range(rng.randrange(1, 8)):
            v ^= 1 << rng.randrange(64)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("inner", [7, 512])
def test_tiles_lose_no_link(monkeypatch, inner):
    monkeypatch.setattr(simhash, "INNER", inner)
    v = near_values(random.Random(2), 700)
    links = simhash.tile_links(np.array(v, np.uint64), None, 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    at = {x: i for i, x in enumerate(v)}
    want = slow_components(v, 4)
    forest = list(range(len(v)))

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        assert x != y  # a forest: no link too many
        forest[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(v))] == want


@pytest.mark.parametrize("tile", [50, None])
def test_components_of_documents(spark, tile):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randrange(2, 150))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice(vocab)
    texts += [None, "", " \n", texts[3], "X" * 200_000]
    rows = [(100 + i, t, "a") for i, t in enumerate(texts)] + [(None, texts[0], "n"), (100, texts[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(simhash.near_duplicates(df, tile=tile).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    fps = [slow_fingerprint(t) for t in texts]
    comp = [100 + c for c in slow_components(fps, 4)]
    want = sorted([(100 + i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp, strict=True))] + [(100, f"{fps[0]:016x}", comp[0])]) + [(None, f"{fps[0]:016x}", comp[0])]
    assert [tuple(r) for r in got] == want
    kept = simhash.keep_first(df, tile=tile)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(comp)) and ids.count(None) == 1


def test_similarity_takes_near_copies_and_leaves_the_rest(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        words = [rng.choice(vocab) for _ in range(250)]
        for k in range(4):
            copy = list(words)
            for _ in range(2 * k):  # at most six words of 250 differ: similarity about 0.8 and more
                copy[rng.randrange(250)] = rng.choice(vocab)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 40, 250])))) for i in range(400)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, radius=12, similarity=0.8).collect()
    comp = {r.doc_id: r.component_id for r in got}
    assert sum(comp[i] == 4 * g for i, g in group.items()) > 0.9 * len(group)
    assert all(comp[i] // 4 == g for i, g in group.items())
    alone = [i for i in comp if i >= 1000]
    texts = dict(rows)
    assert all(comp[i] == i or texts[comp[i]] == texts[i] for i in alone)


def test_sketches_estimate_similarity():
    words = [f"w{i}" for i in range(2000)]
    near, far = list(words), [f"v{i}" for i in range(2000)]
    near[1000] = "other"
    k = [simhash.described(" ".join(w).encode(), 5, simhash.BINS)[1][None] for w in (words, near, far, [], [])]
    assert simhash.alike(k[0], k[1])[0] > 0.85 and simhash.alike(k[0], k[2])[0] < 0.2
    assert simhash.alike(k[3], k[4])[0] == 1 and simhash.alike(k[0], k[3])[0] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_first(df).count() == 0


def test_similarity_is_the_exact_jaccard(spark):
    """Links at 0.8 and over, none under, though sketches and fingerprints are near; repeated shingles count once."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(120):
        words = [rng.choice(vocab) for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        cut = rng.randrange(20, 60)  # a prefix: 196 - cut shingles of 196, 0.9 to 0.69
        rows.append((len(rows), " ".join(words[:-cut])))
    words = [rng.choice(vocab) for _ in range(200)]
    rows += [(900, " ".join(words)), (901, " ".join(words + ["again"] * 2000))]
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = {i: i for i, _ in rows} | {b: a for a, b in [(i, i + 1) for i in range(0, 240, 2)] + [(900, 901)] if alike(a, b)}
    assert want[901] == 900 and 40 < sum(i != c for i, c in want.items()) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=5, radius=18, similarity=0.8, exact=True).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_chunks_lose_no_pair(monkeypatch, spark):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(60)] + [(100 + i, rng.choice([None, "", " "])) for i in range(9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, radius=18, similarity=0.8, exact=True).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 60 else 100 for i, _ in rows}


def test_exact_links_of_few_shingles(spark):
    """Four shingles of five are shared, a similarity of just 0.8, and fingerprints of so few shingles lie far apart."""
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1]))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, radius=18, similarity=0.8, exact=True).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _ in rows}


@pytest.mark.parametrize("sampled", [10, 20_000])
def test_exact_links_against_all_pairs(monkeypatch, spark, sampled):
    """A passage that most texts have, families of near copies and texts that share it alone; the order of shingles loses no link."""
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = ["", None, " ", "w1 w2", "w1 W2 "]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 6, 30, 80]))] + passage * rng.randrange(2)
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own[rng.randrange(3) :]))
    sets = [simhash.shingle_set((t or "").encode(), 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=5, radius=18, similarity=0.8, exact=True).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))}
    assert 20 < len({find(i) for i in range(len(texts))}) < len(texts) - 20


def test_pairs_of_one_chance_shingle_go(spark):
    """Two of the first shingles are shared, or all of a set of one, or a hundredth of the smaller set."""
    rows = [(1, 2, 200, 200, 5), (1, 3, 200, 200, 9), (1, 3, 200, 200, 40), (4, 5, 1, 1, 0), (6, 7, 200, 150, 1), (6, 7, 200, 150, 2), (8, 9, 200, 200, 50), (8, 9, 200, 200, 60), (10, 11, 300, 310, 1), (10, 11, 300, 310, 2)]
    got = simhash.sharing(spark.createDataFrame(rows, "a long, b long, n int, m int, at int"), 0.8)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (4, 5)]


def test_exact_groups_of_short_and_long_texts_by_all_pairs(spark):
    rng = np.random.default_rng(7)
    texts = []
    for n in [*range(1, 16), 40, 120, 400] * 3:
        words = rng.integers(0, 50, n).astype(str)
        texts.append(" ".join(words))
        for _ in range(3):
            other = words.copy()
            other[rng.integers(0, n, max(1, n // 60))] = "x"
            texts.append(" ".join([*other, *["end"] * rng.integers(0, 2)]))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 54 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=5, similarity=0.8, exact=True)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))


def test_only_what_results_read_stays_on_disk(spark):
    from veilspark.llm import linededup
    from veilspark.llm.common import Stash

    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{text} {i}\n{text[:200]}") for i in range(20)], "doc_id long, text string")
    for run in (lambda: simhash.keep_first(df, shingle=5, similarity=0.8, exact=True), lambda: linededup.dedup_lines(df, short=True)):
        mark = len(Stash.live)
        out = run()
        roots = [s.root.removeprefix("file://") for s in Stash.live[mark:]]
        left = [os.path.join(r, x) for r in roots if os.path.isdir(r) for x in os.listdir(r)]
        assert len(left) == 1 and 0 < out.count() <= 20
