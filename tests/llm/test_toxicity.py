"""Held-out accuracy, calibration and edge rows."""

import time
import zlib

import numpy as np

from veilspark.llm import queries, toxicity

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = queries.op1_toxicity(spark, DIR)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows[:200])
    hit = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if r.toxic == 0) / sum(1 - r.toxic for r in rows)
    assert hit > 0.8 and false < 0.01
    top = [r.toxic for r in rows if r.score >= 0.9]
    assert np.mean(top) > 0.85  # calibrated


def test_scores_of_edge_rows(spark):
    rng = np.random.default_rng(0)
    words = ["the", "of", "and", "tion", "near", "you"]
    rows = [(i, " ".join([*rng.choice(words, 30), "idiot" if i % 3 == 0 else "the"]), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert b"idiot" in model.lexicon
    more = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "you IDIOT!!", ""), (3, "the " * 200_000, ""), (4, "id1ot 1d10t you", "")], docs.schema)
    out = toxicity.scored(docs.unionByName(more), model).collect()
    assert len(out) == 405 and all(0 <= r.score <= 1 for r in out)
    assert [r.score > 0.5 for r in out if r.text == "you IDIOT!!"] == [True]
    clean = [r.score for r in out[:400] if r.doc_id % 3]
    assert max(clean) < 0.3
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_without_labels_or_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1)], none.schema)
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, ones)).collect()} == {1.0}


def test_isotonic_is_monotone_and_pools():
    f = np.array([0.0, 1, 2, 3, 4, 5])
    x, y = toxicity.isotonic(f, np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.Boosted(trees=60, depth=3).fit(x[:2000], y[:2000])
    assert ((m.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.9


def test_obfuscated_words():
    assert toxicity.plain_word(b"1d10t") == b"idiot"
    assert toxicity.plain_word(b"st.u.pid") == b"stupid"


def test_long_words_are_read_once():
    for w in (b"a" * 1_000_000, b"1" * 1_000_000, "\u6f22".encode() * 400_000, b"=" * 1_000_000, b"a." * 500_000):
        began = time.time()
        toxicity.features(w, {b"idiot": 1.0})
        assert time.time() - began < 5


def test_features_against_a_plain_reading():
    """Counts of a text, taken again character by character."""
    lexicon = {b"idiot": 2.0, b"fool": 1.0}
    for text in ("You IDIOT!! what a f.o.o.l, an id1ot", "the fool said: 'hm?' YES YES", "one\ttwo  three", "A-b_c 1d10t fo0l!", "\u00e9t\u00e9 idiot tu"):
        f = toxicity.features(text.encode(), lexicon)
        marks = set("!?.,;:'\"()[]{}-_/\\*#$%&@^~|+=<>`")
        words = "".join(" " if c in marks else c.lower() if c.isascii() else c for c in text).split()
        found = [k for k, w in enumerate(words) if w.encode() in lexicon]
        assert f[0] == np.log1p(len(words)) and f[1] == len(found) / len(words) and f[3] == len({words[k] for k in found})
        assert f[4] == sum(lexicon[words[k].encode()] for k in found) / len(words)
        near = sum(any(abs(k - j) <= 4 and words[j].encode() in toxicity.YOU for j in range(len(words))) for k in found)
        assert f[8] == near
        raw = text.encode()
        letters = sum(b > 127 or chr(b).isalpha() for b in raw)
        assert f[9] == sum(65 <= b <= 90 for b in raw) / letters
        assert f[11] == sum(chr(b) in marks for b in raw) / len(raw) and f[12] == text.count("!") / len(words)
        assert f[17] == 2 * ("id1ot" in text)
