"""Files, archives, images, Office documents, records and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.functions.catalog import InputError
from veilspark.operators import search, store
from veilspark.plans import scan as flows
from veilspark.queries import png, sample_files
from veilspark.sources import archives, files, images, office
from veilspark.streaming import watch


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def one(spark, raw, path="/x.zip"):
    return spark.createDataFrame([(path, raw)], "path string, content binary")


def test_archive_limits(spark):
    bomb = zipped(a="a" * 1_100_000)
    assert archives.members(one(spark, bomb)).first().error == "archive_bomb"
    assert archives.members(one(spark, b"nothing")).first().error == "not_an_archive"
    assert archives.members(one(spark, None)).first().error == "not_an_archive"


def test_archive_names(spark):
    names = ["../bad", "/absolute", "C:bad", "a\\b", "a/../../b", "a\0b", "", None, "x" * 181, "folder/report.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.archive_name_ok(F.col("n"))).collect()] == [False] * 9 + [True]


def test_xml_entities_are_refused():
    for enc in ("utf-8", "utf-16"):
        with pytest.raises(archives.Refused, match="xml_entities"):
            archives.parsed_xml('<?xml version="1.0"?><!DOCTYPE a [<!ENTITY b "c">]><a/>'.encode(enc))


def test_office_texts(spark):
    w = '<w:document xmlns:w="urn:w"><w:body>{}</w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", w.format("<w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p>"))
    assert office.office_text(raw.getvalue(), ".docx") == "Hello\nWorld"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="urn:a"><a:p><a:t>slide {n}</a:t></a:p></p>')
    assert office.office_text(raw.getvalue(), ".pptx").index("slide 2") == 0
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Shared text</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<s><row><c t="s"><v>0</v></c><c><v>42</v></c></row><row><c t="s"><v>9</v></c></row></s>')
    assert office.office_text(raw.getvalue(), ".xlsx") == "Shared text\t42\n[invalid shared string]"
    with pytest.raises(archives.Refused, match="no_text_part"):
        office.office_text(zipped(a="b"), ".odt")


def test_hidden_word_content_is_left_out(spark):
    w = 'xmlns:w="urn:w"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Sub"/></w:pPr><w:r><w:t>styled</w:t></w:r></w:p>'
        "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>gone</w:t></w:r><w:r><w:t>seen</w:t></w:r><w:del><w:r><w:t>cut</w:t></w:r></w:del></w:p>"
    )
    styles = '<w:style w:styleId="Base"><w:rPr><w:vanish/></w:rPr></w:style><w:style w:styleId="Sub"><w:basedOn w:val="Base"/></w:style>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    assert [r.text for r in office.docx_fragments(one(spark, raw.getvalue())).collect()] == ["seen"]


def deck(*slides, size=None):
    main = f'<p><sldSz cx="{size[0]}" cy="{size[1]}"/></p>' if size else "<p/>"
    return zipped(**{"ppt__presentation.xml": main}, **{f"ppt__slides__slide{n}.xml": x for n, x in enumerate(slides, 1)})


def test_decks_are_rebuilt(spark):
    box = '<s xmlns:a="urn:a"{}><sp><spPr><a:xfrm><a:off x="11" y="12"/><a:ext cx="200000" cy="3"/></a:xfrm></spPr><txBody><a:p><a:t>{}</a:t></a:p><a:p/></txBody></sp></s>'
    table = '<s xmlns:a="urn:a"><graphicFrame><xfrm><a:off x="5" y="6"/></xfrm><a:tbl><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc><a:tc><a:p><a:t>y@example.org</a:t></a:p></a:tc></a:tr></a:tbl></graphicFrame></s>'
    raw = deck(box.format("", "a &amp; b@example.org"), box.format(' show="0"', "hidden"), "<s/>", table, size=(4000000, 3000000))
    found = office.clean_fragments(office.pptx_fragments(one(spark, raw)))
    clean = office.rebuilt_pptx(found).first()
    again = office.pptx_fragments(one(spark, bytes(clean.clean))).orderBy("slide", "shape").collect()
    assert [tuple(r)[1:] for r in again] == [
        (1, -1, 0, 0, 4000000, 3000000, ""),
        (1, 0, 11, 12, 200000, 91440, "a & [EMAIL_1]\n"),
        (2, -1, 0, 0, 4000000, 3000000, ""),
        (3, -1, 0, 0, 4000000, 3000000, ""),
        (3, 0, 5, 6, 91440, 91440, "x | [EMAIL_1]"),
    ]
    assert clean.removed == 2 and b"hidden" not in clean.clean
    with zipfile.ZipFile(io.BytesIO(clean.clean)) as z:
        named = [n for n in z.namelist() if n.endswith(".rels")]
        for n in named:  # every relationship leads to a part of the file
            at = n.split("_rels/")[0]
            for x in archives.parsed_xml(z.read(n)):
                up, target = x.get("Target").count("../"), x.get("Target").replace("../", "")
                folder = "/".join(at.rstrip("/").split("/")[: -up or None])
                assert (folder + "/" + target if folder else target) in z.namelist()
    assert len(named) == 7


def test_decks_that_are_refused(spark):
    for raw, code in ((zipped(a="b"), "slide_limit"), (deck(*["<s/>"] * 101), "slide_limit"), (deck('<s show="0"/>'), "no_visible_slides")):
        with pytest.raises(Exception, match=code):
            office.pptx_fragments(one(spark, raw)).collect()


def test_office_metadata():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("docProps/core.xml", "<a/>")
        z.writestr("word/comments.xml", "<a/>")
        z.writestr("word/vbaProject.bin", "x")
        z.writestr("customXml/item1.xml", "<a/>")
        z.writestr("_rels/.rels", '<r><x TargetMode="External"/></r>')
        z.writestr("word/document.xml", '<d xmlns:w="urn:w"><w:ins/><w:del/></d>')
    kinds = [k for k, _ in office.office_metadata(raw.getvalue())]
    assert sorted(kinds) == ["comments", "custom_xml", "embedded", "external_links", "metadata", "revision"]


def test_png_checks(spark):
    good = png(b"x")
    clean, found, width, height, moving = images.png_parts(good)
    assert images.png_parts(clean)[1] == [] and (width, height, moving) == (3, 2, False) and len(found) == 2
    for raw, code in ((b"no", "not_a_png"), (good[:50], "truncated_chunk"), (good.replace(b"Comment", b"Xomment"), "bad_crc"), (good[: good.index(b"IDAT") - 4], "incomplete")):
        with pytest.raises(images.Refused, match=code):
            images.png_chunks(raw)
    assert images.png_rows(one(spark, None)).first().error == "not_a_png"


def test_jpeg_checks():
    with pytest.raises(images.Refused, match="truncated_segment"):
        images.jpeg_segments(b"\xff\xd8\xff\xe1\x00\xff")
    with pytest.raises(images.Refused, match="not_a_jpeg"):
        images.jpeg_segments(b"GIF8")


@pytest.mark.parametrize(
    ("raw", "text", "error"),
    [(b"plain", "plain", None), ("café".encode("utf-16"), "café", None), (b"caf\xe9", "café", None), (b"a\0b", None, "binary"), (b"\xff\x00\xe9", None, "binary"), (b"x\x81\xe9", None, "unknown_encoding"), (b"", "", None), (b"\xef\xbb\xbfhi", "hi", None)],
)
def test_decoding(spark, raw, text, error):
    r = one(spark, raw).select(T.decoded(F.col("content")).alias("r")).first().r
    assert (r.text, r.error) == (text, error)


def test_folder_flow(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("Mail a@b.org")
    (tmp_path / "in" / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "in" / ".git" / "c.txt").write_text("x@y.org")
    root = f"file://{tmp_path}/in"
    reports = flows.scan(spark, root)
    got = {r.name: r for r in reports.collect()}
    assert set(got) == {"a.txt", "b.bin"} and got["a.txt"].findings == 1 and got["b.bin"].error == "unsupported"
    assert "a@b.org" not in str(got["a.txt"])
    held = spark.createDataFrame(reports.collect(), reports.schema)
    copy = flows.clean_copies(spark, held).collect()
    assert [(r.clean, r.changed) for r in copy] == [("Mail [EMAIL_1]", False)]
    (tmp_path / "in" / "a.txt").write_text("Mail c@d.org")
    assert [(r.clean, r.changed) for r in flows.clean_copies(spark, held).collect()] == [(None, True)]
    with pytest.raises(InputError):
        files.scan_files(spark, root, limit=1)
    flows.write_once(held.select("name"), f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        flows.write_once(held.select("name"), f"{tmp_path}/out")


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create()
    s.put_setting("k", "1")
    s.put_setting("k", "2")
    assert s.get("settings", "key", "k").first().value == "2"
    s.add_scans(spark.createDataFrame([("/a", "2024", ("a", 1))], "path string, created string, report struct<name:string,findings:int>"), "{}")
    ident = s.table("scans").first().id
    s.set_output(ident, "done")
    row = store.listing(s.table("scans")).first()
    assert (row.name, row.findings, row.output) == ("a", 1, "done")
    s.job_event(id="j", kind="scan", status="running", created="1", progress=10)
    s.recover()
    assert s.table("jobs").first().status == "interrupted"


def test_search_and_summary(spark):
    rows = [(1, "", "The invoice from the supplier is a payment due."), (2, "", "A football match was played."), (3, "", "Supplier payment and invoice records.")]
    docs = spark.createDataFrame(rows, "id long, name string, text string")
    assert search.search(docs, "supplier payment").orderBy("rank").first().id in (1, 3)
    assert search.lsa_search(docs, "supplier payment").orderBy("rank").first().id in (1, 3)
    assert search.search(docs, "zebra").count() == 0
    for bad in ("", " ", "x" * 4001):
        with pytest.raises(InputError):
            search.search(docs, bad)
    text = "One sentence about invoices here. Another sentence about invoices too. Something else entirely different. The invoices are the topic here."
    got = search.summaries(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string"), 2)
    out = {r.doc_id: r.summary for r in got.collect()}
    assert len(out[1].split("\n")) == 2 and all(s in text for s in out[1].split("\n")) and out[2] == out[3] == ""


def test_search_reads_whole_texts(spark):
    long = "filler words about nothing " * 12_000 + "the payment of a distant supplier"
    docs = spark.createDataFrame([(1, "", long), (2, "", "A football match was played."), (3, "", None)], "id long, name string, text string")
    for find in (search.lsa_search, search.search):
        hit = find(docs, "distant supplier").orderBy("rank").first()
        assert hit.id == 1 and "distant supplier" in long[hit.chunk_offset - 1 :][:1800] and hit.chunk_offset > 250_000
    texts = ["", " \n", "é" * 5, "x" * 1620, "😀 y" * 541, "ab c" * 26_000, "ab c" * 26_320 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(tuple(r) for r in search.chunks(df, F.col("t"), "id").collect())
    assert got == [(n, i, t[i : i + 1800]) for n, t in enumerate(texts) for i in range(0, len(t), 1620) if t[i : i + 1800].strip()]


def test_globs(spark):
    df = spark.createDataFrame([("a/b.tmp",), ("x/.env",), ("keep/me.txt",), ("log1",)], "p string")
    got = [r.p for r in df.where(~T.excluded(F.col("p"), ("*.tmp", ".env", "log[0-9]"))).collect()]
    assert got == ["keep/me.txt"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a@b.org")
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt")
    watch.watch_folder(*args).awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text("10.0.0.1")
    watch.watch_folder(*args).awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.findings for r in out.collect()) == [1, 1]
    spark.createDataFrame([("2024-01-01 00:00:01", "a@b.org"), ("2024-01-01 00:09:00", "a@b.org b@c.org")], "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/events")
    q = watch.windowed_counts(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
    red = watch.redacted_stream(stream).writeStream.format("memory").queryName("red").trigger(availableNow=True).start()
    red.awaitTermination(120)
    assert {r.redacted for r in spark.table("red").collect()} == {"[EMAIL_1]", "[EMAIL_1] [EMAIL_2]"}


def test_sample_files_are_what_the_queries_say(spark):
    got = {r.path for r in sample_files(spark, "/root/testdata/sf0.001", "zip", "txt").select("path").collect()}
    keys = [r.s_suppkey for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()]
    assert got == {f"/in/{k}.{kind}" for k in keys for kind in ("zip", "txt")}


def test_lsa_scores_against_numpy(spark, monkeypatch):
    """Scores of all three ways to the singular vectors, over more terms than RowMatrix solves in a minute."""
    import random

    import numpy as np

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choice(vocab[t * 30 : t * 30 + 90]) for _ in range(40)) for t in range(24) for _ in range(6)]
    parts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk string, part string")
    counts = search.term_counts(parts, "chunk", search.F.col("part"))
    weights = {(r.chunk, r.term): r.w for r in search.weighted(counts, search.vocabulary(counts, len(texts)), "chunk").collect()}
    terms = sorted({t for _, t in weights})
    a = np.array([[weights.get((str(c), t), 0.0) for t in terms] for c in range(len(texts))])
    asked = search.weighted(search.term_counts(search.query_of(spark, texts[7][:60]), "q", search.F.col("text")), search.vocabulary(counts, len(texts)), "q").collect()
    q = np.zeros(len(terms))
    for r in asked:
        q[terms.index(r.term)] = r.w
    v = np.linalg.svd(a, full_matrices=False)[2][:20].T
    d, q = a @ v, q @ v
    want = d @ q / np.linalg.norm(d, axis=1) / np.linalg.norm(q)
    assert len(terms) > 4000
    for whole in (1, 2048):
        monkeypatch.setattr(search, "WHOLE", whole)
        got = {r.chunk: r.score for r in search.lsa_scores(parts, texts[7][:60], 20).collect()}
        assert len(got) == len(texts) and max(abs(got[str(c)] - w) for c, w in enumerate(want)) < 2e-6
    # Few terms, many rows: the matrix of the terms.
    of = {t: i for i, t in enumerate(sorted({t for _, t in weights if " " not in t}))}
    rows = [([(of[t], w) for t, w in sorted((t, w) for (c, t), w in weights.items() if c == str(n) and t in of)],) for n in range(len(texts))]
    right = search.right_vectors(spark.createDataFrame(rows, "v array<struct<i:int,w:double>>"), 10**6, len(of), 20)
    b = np.zeros((len(rows), len(of)))
    for n, (r,) in enumerate(rows):
        for i, w in r:
            b[n, i] = w
    v = np.linalg.svd(b, full_matrices=False)[2][:20].T
    assert np.abs(right @ right.T - v @ v.T).max() < 1e-6
