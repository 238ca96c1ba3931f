"""Held-out findings, places in the text, and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import secrets


#: Forms that training does not see: a token in base 64 and a short password after key words, service keys, identifiers, paths.
UNSEEN = (1, 3, 8, 10, 16)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.createDataFrame([secrets.dictionary(docs).first()], "pairs array<string>, words array<string>")
    labelled = secrets.findings(spark)
    part = (F.col("id") % 20).isin(*UNSEEN)
    return secrets.train(labelled.where(~part), known), known, labelled.where(part)


def test_forms_that_training_has_not_seen(spark, trained):
    model, known, rest = trained
    got = secrets.scan(rest, model, known, "id").join(rest.select("id", F.col("start").alias("s"), "label"), "id").where("start = s")
    n = {(r.id % 20, r.label, r.secret): r["count"] for r in got.groupBy((F.col("id") % 20).alias("id"), "label", "secret").count().collect()}
    hit = sum(c for (_, y, p), c in n.items() if y and p) / rest.where("label = 1").count()
    false = sum(c for (_, y, p), c in n.items() if not y and p) / rest.where("label = 0").count()
    assert hit > 0.9 and false < 0.1, n


def test_dictionary_counts_every_pair_and_word(spark):
    texts = ["the weather there", "Weather, wea-ther", None, "", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    row = secrets.dictionary(df, most_pairs=4, most_words=2).first()
    from collections import Counter

    pairs, words = Counter(), Counter()
    for w in "the weather there weather wea ther".split():
        words[w] += 1
        pairs.update(w[i : i + 2] for i in range(len(w) - 1))
    top = lambda c, n: sorted(x for x, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:n])
    assert (row.pairs, row.words) == (top(pairs, 4), top(words, 2))


def plain_candidates(text):
    """Runs of key characters with a letter and a digit, and values after key words, read off character by character."""
    run, tail = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~-"), "+/_-"
    out, i = [], 0
    while i < len(text):
        if text[i] not in run:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in run:
            j += 1
        s, e = i, j
        while s < e and not (text[s].isalnum() or text[s] in "+/_~-"):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in tail):
            e -= 1
        pad = 0
        while e == j and pad < 2 and text[j + pad : j + pad + 1] == "=":
            pad += 1
        v = text[s:e]
        if s == i and len(v) >= 16 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and text[e + pad : e + pad + 1] != "=":
            out.append((s, e + pad))
        i = j
    return out


def test_candidates_against_a_plain_reading(spark):
    """Texts without key words: the runs alone are candidates."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bits = ["".join(rng.choices("abcXYZ019+/_-", k=rng.choice([3, 9, 15, 16, 17, 30, 60]))) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(b + rng.choice([" ", ", ", "\n", "= ", "== ", " \u00e9", "(", "; "]) for b in bits)))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {i: [] for i, _ in rows}
    for r in secrets.candidates(df).collect():
        got[r.id].append((r.start, r.end))
    assert {i: sorted(x) for i, x in got.items()} == {i: plain_candidates(t) for i, t in rows}


def test_tokens_of_the_documents_are_found(spark, trained):
    model, known, _ = trained
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, m.start(1)) for r in docs.select("doc_id", "text").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    rows = secrets.scan(docs, model, known).where("secret").collect()
    assert want and want <= {(r.doc_id, r.start) for r in rows}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(text[r.doc_id][r.start : r.end] == r.value for r in rows)


def test_edges(spark, trained):
    model, known, _ = trained
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, None, 0), (2, "", 0), (3, f"\ufdd0\U0001f600 token = \"{key}\"", 0), (3, f"\ufdd0\U0001f600 token = \"{key}\"", 0), (None, f"secret={key}", 0), (4, "plain words " * 20_000, 0), (5, key * 4000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = secrets.scan(df, model, known).collect()
    assert sorted((r.start, r.end) for r in out if r.doc_id == 3) == [(12, 52)] * 2
    assert {r.doc_id for r in out} == {3, None, 5} and all(0 <= r.probability <= 1 for r in out)
    assert secrets.scan(df.limit(0), model, known).count() == 0


def test_values_after_key_words_and_equals_signs(spark):
    texts = {
        "token=9b0b3c6a43eb78aa99cbd7049c572391524f37a8": (6, 46),
        "API_KEY=ghp_0aB1cD2eF3gH4iJ5kL6mN7oP8": (8, 37),
        "AWS_SECRET_ACCESS_KEY_ID2=wJalrXUtnFEMIK7MDENG/bPx": (26, 50),
        "password: Tr0ub4dor3 ": (10, 20),
        "password: S3cr3t!Pass#word99": (10, 28),
        'password = "qwErtyUiopAsdfGh"': (12, 28),
        "The password is Hunter2Hunter2.": (16, 30),
        "data dGhpcyBpcyBhIGtleSAxMjM0== end": (5, 31),
        "passwords are plain words here": None,
        "password: short1": None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: [] for r in df.selectExpr("doc_id as id").collect()}
    for r in secrets.candidates(df).collect():
        got[r.id].append((r.start, r.end))
    assert {t: got[i] for i, t in enumerate(texts)} == {t: [x] if x else [] for t, x in texts.items()}


def test_findings_without_a_candidate_count_as_missed(spark, trained):
    model, known, rest = trained
    assert secrets.missed(rest).count() == 0
    found = secrets.scan(rest, model, known, "id").where("secret").select("id", "start")
    hits = rest.where("label = 1").join(found, ["id", "start"], "left_semi").count()
    assert hits / rest.where("label = 1").count() > 0.95
    lost = spark.createDataFrame([(1, "plain words", 0, 1.0), (2, "plain words", 0, 0.0)], "id long, text string, start int, label double")
    assert [r.id for r in secrets.missed(lost).collect()] == [1]
