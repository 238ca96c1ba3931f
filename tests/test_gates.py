"""Gates before a copy leaves, on rows that define them."""

from pyspark.sql import functions as F

from veilspark.operators import gates, layout
from veilspark.operators import detect as D


def test_second_views(spark):
    words = spark.createDataFrame([(1, 1, 0, "ab"), (1, 1, 1, "cd"), (1, 2, 2, "xy")], "doc_id int, page int, word_no int, text string")
    chars = spark.createDataFrame([(1, 1, i, c) for i, c in enumerate("ab  cd")] + [(1, 2, 0, "y"), (1, 2, 1, "x"), (2, 1, 0, "z"), (3, 1, 0, "")], "doc_id int, page int, ordinal int, text string")
    assert sorted(map(tuple, gates.second_views(words, chars).collect())) == [(1, 2, "yx"), (2, 1, "z")]


def test_turned_pages(spark):
    rows = [(1, 1, [0, 90]), (1, 2, [180]), (1, 3, []), (1, 4, [90]), (1, 5, [90]), (1, 6, [0]), (2, 1, [270, 180]), (2, 2, []), (2, 3, [90]), (2, 4, [180])]
    got = {(r.doc_id, r.page): (r.angle, r.unresolved) for r in gates.turned_pages(spark.createDataFrame(rows, "doc_id int, page int, angles array<int>")).collect()}
    # Document 1 spends 2, 3 and 1 readings; document 2 spends 2, 3 and 1.
    assert got == {(1, 1): (0, False), (1, 2): (180, False), (1, 3): (None, True), (1, 4): (90, False), (1, 5): (None, True), (1, 6): (0, False), (2, 1): (180, False), (2, 2): (None, True), (2, 3): (90, False), (2, 4): (None, True)}


def test_masks(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc_id int")
    assert [tuple(r) for r in gates.without_masks(ids(1, 1, 2), ids(2, 3)).collect()] == [(1, "regions_required")]
    assert sorted(map(tuple, gates.painted(ids(1, 1, 2), ids(1, 3), ids(1, 1, 4)).collect())) == [(1, 2, 2, 3), (2, 1, 0, 0), (3, 0, 0, 1), (4, 0, 1, 1)]


def test_places(spark):
    rows = [("/a/b/c", "/a/b", True), ("/a/b", "/a/b/", True), ("/a/bc", "/a/b", False), ("/a/b/../c", "/a/b", False), ("/a//b/./c/../d", "/a/b", True), ("/../a", "/a", True), ("/x", "/", True)]
    df = spark.createDataFrame(rows, "p string, r string, want boolean")
    assert df.where(gates.within(F.col("p"), F.col("r")) != F.col("want")).count() == 0
    names = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2)], "label string, key int").select(gates.output_name(F.col("label"), F.col("key")).alias("n"))
    assert len({r.n for r in names.collect()}) == 2 and all(len(r.n) == 14 for r in names.collect())
    files = spark.createDataFrame([("/e/b.txt", False), ("/e/a.txt", False), ("/e/README.txt", False), ("/e/sub", True)], "path string, is_dir boolean")
    assert [r.path for r in gates.examples(files).collect()] == ["/e/a.txt", "/e/b.txt"]


def test_recognised_and_native_documents(spark):
    cols = "doc_id int, page int, word_no int, text string, line int, x0 double, y0 double, x1 double, y1 double, is_ocr boolean, confidence double"
    w = layout.with_offsets(spark.createDataFrame([(1, 1, 0, "QA_SECRET_CANRY", 0, 0.0, 0.0, 120.0, 20.0, True, 50.0)], cols))
    texts = layout.rebuilt(w)
    found, reviews = gates.recognised(texts, w, layout.runs(w, texts), ["QA_SECRET_CANARY"], ocr=True)
    assert [(r.start, r.end, r.ocr_candidate) for r in found.collect()] == [(0, 15, True)]
    assert reviews.first().warnings == ["near_matches", "low_or_unknown_score"] and not reviews.first().requires_confirmation
    found, reviews = gates.recognised(texts, w, layout.runs(w, texts), ["QA_SECRET_CANARY"], ocr=False)
    assert found.count() == 0 and reviews.first().warnings == []


def test_functions_in_sql(spark):
    assert gates.register(spark) == ["veil_normal", "veil_card"]
    got = spark.sql("SELECT veil_normal('Ａ-b C') AS a, veil_card('4111 1111 1111 1111') AS b, veil_card('4111 1111 1111 1112') AS c, veil_card('0000 0000 0000 0000') AS d").first()
    assert tuple(got) == ("abc", True, False, False)


def test_an_empty_list_of_rules_finds_nothing(spark):
    docs = D.detect(spark.createDataFrame([(1, "a@b.org")], "doc_id int, text string"), literals=[])
    assert docs.first().spans[0].kind == "email"
