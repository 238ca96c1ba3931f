"""Positioned words and near matches, on the small layouts that define them."""

import itertools

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect as D
from veilspark.operators import fuzzy, layout

COLS = "doc_id int, page int, word_no int, text string, line int, x0 double, y0 double, x1 double, y1 double, is_ocr boolean, confidence double, orientation int"


def words(spark, rows):
    """rows: (text, line, x or None, is_ocr, confidence, page); x follows the words of a line at eight points a character."""
    out, x, last = [], 0.0, None
    for n, (text, line, at, ocr, conf, page) in enumerate(rows):
        x = at if at is not None else (x + 10 if (page, line) == last else 0.0)
        out.append((1, page, n, text, line, x, line * 30.0, x + 8 * len(text), line * 30.0 + 20, ocr, conf, 0))
        x, last = x + 8 * len(text), (page, line)
    return layout.with_offsets(spark.createDataFrame(out, COLS))


def simple(*texts, line=0):
    return [(t, line, None, True, 90.0, 1) for t in texts]


REVIEW = "doc_id int, unmatched_rule_ids array<int>, short_rule_ids array<int>, unresolved_pages array<int>, n_candidates long, weak boolean, requires_confirmation boolean"


def found(spark, rows, literals):
    w = words(spark, rows)
    texts = layout.rebuilt(w)
    docs = D.detect(texts, literals=literals)
    runs = layout.runs(w, texts)
    return fuzzy.matches(docs, w, literals, runs).collect(), fuzzy.review(docs, runs, literals).first()


@pytest.mark.parametrize(
    ("rows", "literal", "edits"),
    [
        (simple("OA_SECRET_CANARY"), "QA_SECRET_CANARY", 1),
        (simple("QXA_SECRET_CANARY"), "QA_SECRET_CANARY", 1),
        (simple("QA_SECRET_CANRY"), "QA_SECRET_CANARY", 1),
        (simple("PROJXCT_PRIVATE_CANARX"), "PROJECT_PRIVATE_CANARY", 2),
        (simple("QA", "SECRET", "CANARY"), "QA_SECRET_CANARY", 0),
        (simple("ＰＲＩＶＡＴＥＶＡＬＵＥ"), "PRIVATEVALUE", 0),
    ],
)
def test_near_values_are_found(spark, rows, literal, edits):
    got, review = found(spark, rows, [literal])
    assert [(m.rule_id, m.edits) for m in got] == [(1, edits)]
    assert not review.requires_confirmation


@pytest.mark.parametrize(
    ("rows", "literal"),
    [
        (simple("ZZ_ZECRET_CANARY"), "QA_SECRET_CANARY"),
        (simple("UNRELATED_OA_SECRET_CANARY_SUFFIX"), "QA_SECRET_CANARY"),
        (simple("Alive"), "Alice"),
        (simple("ABAAAAAA"), "AAAAAAAA"),
        ([*simple("PRIVATE"), *simple("VALUE", line=2)], "PRIVATEVALUE"),
        ([("PRIVATE", 0, 0.0, True, 90.0, 1), ("VALUE", 0, 700.0, True, 90.0, 1)], "PRIVATEVALUE"),
        ([("PRIVATE", 0, 0.0, True, 90.0, 1), ("VALUE", 0, 70.0, True, 90.0, 2)], "PRIVATEVALUE"),
        ([("PRIVATE", 0, 0.0, True, 90.0, 1), ("native", 0, 66.0, False, None, 1), ("VALUE", 0, 120.0, True, 90.0, 1)], "PRIVATEVALUE"),
    ],
)
def test_unlike_values_are_not(spark, rows, literal):
    got, review = found(spark, rows, [literal])
    assert got == [] and review.unmatched_rule_ids == [1] and review.requires_confirmation


def test_second_word_stays_covered(spark):
    got, _ = found(spark, simple("PRIVATEVALUE", "L0NGSECRET"), ["PRIVATEVALUE", "PRIVATEVALUE LONGSECRET"])
    assert [(m.rule_id, m.start, m.end) for m in got] == [(2, 0, 23)]


def test_confidence_is_null_if_any_is_not_a_score(spark):
    rows = [("QA", 0, None, True, 55.0, 1), ("SECRET", 0, None, True, 150.0, 1), ("CANARY", 0, None, True, 80.0, 1)]
    got, review = found(spark, rows, ["QA_SECRET_CANARY"])
    assert got[0].confidence is None and review.weak
    assert fuzzy.warnings(spark.createDataFrame([review], REVIEW)).first().warnings == [fuzzy.NEAR, fuzzy.WEAK]


def test_bounded_distance_is_exact(spark):
    every = ["".join(p) for n in range(5) for p in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(a, b) for a in every for b in every], "a string, b string")
    for limit in (1, 2):
        bad = df.where(fuzzy.distance(F.col("a"), F.col("b"), F.lit(limit)) != F.least(F.levenshtein("a", "b"), F.lit(limit + 1)))
        assert bad.count() == 0


def test_distances_of_all_pairs(monkeypatch, spark):
    """Blocks of keys give the pairs of a plain join, with repeated keys and nulls; equal values are compared once."""
    monkeypatch.setattr(fuzzy, "BLOCK", 3)
    rows = [(n % 37, ["ring", "rang", "bolt", "", "bring"][n % 5], n % 2) for n in range(60)] + [(None, "ring", 1), (7, "ring", None), (90, None, 1), (91, None, 1)]
    df = spark.createDataFrame(rows, "k int, v string, g int")
    got = sorted((tuple(r) for r in fuzzy.distances(df, "k", "v", "g", 2).collect()), key=repr)
    one, two = df.selectExpr("k a", "v va", "g ga"), df.selectExpr("k b", "v vb", "g gb")
    want = one.join(two, F.expr("a < b and ga = gb")).select("a", "b", fuzzy.distance(F.col("va"), F.col("vb"), F.lit(2)).alias("d"))
    assert got == sorted((tuple(r) for r in want.collect()), key=repr) and len(got) > 800


def test_boxes_are_checked(spark):
    base = [(1, 1, n, "word", 0, *box, True, 90.0, 0) for n, box in enumerate([(0.0, 0.0, 30.0, 20.0), (0.0, 0.0, 0.0, 20.0), (-1.0, 0.0, 30.0, 20.0), (0.0, 0.0, 999.0, 20.0), (float("nan"), 0.0, 30.0, 20.0)])]
    w = layout.with_offsets(spark.createDataFrame(base, COLS))
    pages = spark.createDataFrame([(1, 1, 900.0, 200.0)], "doc_id int, page int, width double, height double")
    ok = [r.valid for r in layout.valid_words(w, pages, layout.rebuilt(w)).orderBy("word_no").collect()]
    assert ok == [True, False, False, False, False]


def test_words_are_not_dealt_again(spark):
    """Only texts are dealt, once for each time they are read; words and their texts are joined in place."""
    from veilspark import queries

    plan = queries.valid_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)


def test_offsets_are_checked(spark):
    """Words whose places do not give their text are not valid; pages listed twice give a word twice, unlisted ones no size."""
    box, schema = (0.0, 0.0, 9.0, 9.0), "doc_id int, page int, word_no int, text string, start int, end int, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 1, 1, "a\U0001f600b", 0, 3, *box), (1, 1, 2, "cd", 4, 6, *box), (1, 1, 3, "cd", 5, 7, *box), (1, 1, 4, "cd", -1, 1, *box), (1, 1, 5, "", 2, 2, *box), (1, 2, 6, "cd", 4, 6, *box), (2, 1, 7, "cd", 4, 6, *box), (1, 1, 8, "cd", None, 6, *box), (1, 3, 9, "cd", 4, 6, *box)]
    w = spark.createDataFrame(rows, schema)
    texts = spark.createDataFrame([(1, "a\U0001f600b cd\n")], "doc_id int, text string")
    pages = spark.createDataFrame([(1, 1, 20.0, 20.0), (1, 3, 20.0, 20.0), (1, 3, 4.0, 20.0), (2, 1, 20.0, 20.0)], "doc_id int, page int, width double, height double")
    got = layout.valid_words(w, pages, texts)
    assert got.columns == [*w.columns, "valid"]
    assert sorted((r.word_no, r.valid) for r in got.collect()) == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False), (9, False), (9, True)]


def test_rotations_are_undone(spark):
    # What a box [15, 20, 45, 40] of a 120 x 80 page becomes when the page is turned.
    turned = {90: (20, 75, 40, 105), 180: (75, 40, 105, 60), 270: (40, 15, 60, 45), 0: (15, 20, 45, 40)}
    for angle, box in turned.items():
        got = spark.range(1).select(layout.undo_rotation(*map(F.lit, box), F.lit(angle), F.lit(120), F.lit(80))).first()[0]
        assert got == [15, 20, 45, 40]


def test_offsets_span_pages(spark):
    rows = [("one", 0, None, True, 1.0, 1), ("two", 0, None, True, 1.0, 1), ("three", 0, 0.0, True, 1.0, 3)]
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id int, page int")
    w = layout.with_offsets(words(spark, rows).drop("start", "end"), pages)
    text = layout.rebuilt(w, pages).first().text
    assert text == "one two\n\n\nthree\n"
    assert all(text[r.start : r.end] == r.text for r in w.collect())


def test_hidden_styles_are_inherited(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "child string, parent string")
    seeds = spark.createDataFrame([("a",)], "child string")
    assert {r.child for r in layout.closure(edges, seeds).collect()} == {"a", "b", "c"}


def test_inheritance_in_cycles_and_long_chains(spark):
    seeds = spark.createDataFrame([("s0",), (None,)], "child string")
    chain = [(f"s{i + 1}", f"s{i}") for i in range(500)]
    cycle = [("s3", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "s500"), ("self", "self"), (None, "s0"), ("free", None), ("o1", "o2"), ("o2", "o1")]
    edges = spark.createDataFrame(chain + cycle + chain[:3], "child string, parent string")
    got = sorted(r.child for r in layout.closure(edges, seeds).collect())
    assert got == sorted([f"s{i}" for i in range(501)] + ["c1", "c2"])
    twice = [layout.closure(spark.createDataFrame([e], "child string, parent string"), seeds) for e in (("a", "s0"), ("b", "s0"))]
    assert [sorted(r.child for r in x.collect()) for x in twice] == [["a", "s0"], ["b", "s0"]]
    assert layout.closure(edges.limit(0), seeds).count() == 1 and layout.closure(edges, seeds.limit(0)).count() == 0


def test_review_without_rules(spark):
    docs = D.detect(spark.createDataFrame([(1, "text")], "doc_id int, text string"))
    runs = layout.runs(words(spark, simple("text")))
    assert list(fuzzy.review(docs, runs, []).first()) == [1, [], [], [], 0, False, False]


def test_many_candidates_are_an_error(spark):
    found = spark.createDataFrame([(1, 0)] * 3 + [(2, 0)], "doc_id int, rule_id int")
    assert [tuple(r) for r in fuzzy.too_many(found, 2).collect()] == [(1, "too_many_candidates")]
    assert fuzzy.too_many(found).count() == 0


def test_reviews_that_may_be_exported(spark):
    rows = [(1, [], [], [], 0, False, False), (2, [1], [], [], 0, False, True)]
    reviews = spark.createDataFrame(rows, REVIEW)
    assert [r.doc_id for r in fuzzy.exportable(reviews, False).collect()] == [1] and fuzzy.exportable(reviews, True).count() == 2
    with pytest.raises(TypeError):
        fuzzy.exportable(reviews, None)
    found = spark.createDataFrame([(1, 4, 9)], "doc_id int, start int, end int")
    docs = D.detect(spark.createDataFrame([(1, "a@b.org x")], "doc_id int, text string"))
    assert [(r.kind, r.start, r.ocr_candidate) for r in fuzzy.all_matches(docs, found).orderBy("n").collect()] == [("email", 0, False), ("custom", 4, True)]
