"""Measures against plain Python, and what the chosen cutoffs promise."""

import math
import random
import re

from pyspark.sql import functions as F

from veilspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    for _ in range(250):
        n = rng.choice([0, 1, 7, 8, 9, 17, 60])
        yield rng.choice([" ", "\n", " \t"]).join(rng.choice(["a", "b", "#", "é", "\U0001f600x"][: rng.randrange(1, 6)]) for _ in range(n))
    yield from (None, "", "\n \n", "x\u00a0y " * 9, "w " * 30_000, "one two three four five six seven eight " * 2)


def test_measures(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    for r in quality.measured(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(r.text), r.text


def test_binomial_tail(spark):
    cases = [(0, 50, 0.02), (3, 100, 0.1), (10, 5000, 0.004), (500, 200_000, 0.004), (4900, 1_000_000, 0.005), (2, 100, 0.001)]
    df = spark.createDataFrame([(float(k), float(n), p) for k, n, p in cases], "k double, n double, p double")
    for r in df.withColumn("t", F.expr(quality.binomial_tail("k", "n", "p"))).collect():
        k, n, p = int(r.k), int(r.n), r.p
        if k >= n * p:
            assert r.t == 1
        else:
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert abs(r.t / want - 1) < 1e-6


def corpus(spark, n=6000):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(10_000)}" + ("###" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None])))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_reject_the_bad_and_keep_the_good(spark):
    docs, labels = corpus(spark)
    out = quality.judged(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id")
    rate = {r.quality: r.k for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] >= 1 - quality.ALPHA and rate[0] < 0.05


def test_useless_or_unsafe_rules_reject_nothing(spark):
    docs, labels = corpus(spark, 3000)
    noise = labels.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).cast("int").alias("quality"))
    assert quality.judged(docs, noise).where("not kept and not base_failed").count() == 0
    few = labels.limit(20)
    assert quality.judged(docs, few).where("not kept and not base_failed").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, lang string, kept string"
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (None, "w " * 40, "en", "x"), (3, "a b " * 10, "en", "x"), (3, "a b " * 10, "en", "x")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.id, r.base_failed, r.kept) for r in quality.judged(docs, none).collect()]
    assert len(got) == 5 and all(kept != failed for _, failed, kept in got)
    assert quality.judged(docs.limit(0), none).count() == 0
