"""Detection and redaction: texts with findings written out by hand, and texts made of values that are known to be fine or not."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.functions.catalog import InputError, literals_of
from veilspark.operators import detect as D

#: Text, its findings in order, and the text with labels, all written by hand.
BY_HAND = [
    (
        "Name: Alex Example\nEmail: a@b.test, A@B.TEST and c@d.test\nAddress: 12 Some Street, Town",
        [("name", "Alex Example"), ("email", "a@b.test"), ("email", "A@B.TEST"), ("email", "c@d.test"), ("address", "12 Some Street, Town")],
        "Name: [NAME_1]\nEmail: [EMAIL_1], [EMAIL_1] and [EMAIL_2]\nAddress: [ADDRESS_1]",
    ),
    ("GB82 WEST 1234 5698 7654 32 then 4111 1111 1111 1111", [("iban", "GB82 WEST 1234 5698 7654 32"), ("card", "4111 1111 1111 1111")], "[IBAN_1] then [CARD_1]"),
    # A wrong check number leaves digits that still look like a phone.
    ("GB83 WEST 1234 5698 7654 32", [("phone", "1234 5698 7654 32")], "GB83 WEST [PHONE_1]"),
    # No octet over 255 or with a leading zero, no dot after the last, no dates.
    (
        "\U0001f600 a@b.test 10.0.0.1. 192.168.1.1 999.1.1.1 01.2.3.4 2024-01-02 +92 300 1234567",
        [("email", "a@b.test"), ("ipv4", "192.168.1.1"), ("phone", "+92 300 1234567")],
        "\U0001f600 [EMAIL_1] 10.0.0.1. [IPV4_1] 999.1.1.1 01.2.3.4 2024-01-02 [PHONE_1]",
    ),
    # Blanks around the colon may hold a line end; a value of a letter takes the blank.
    ("NAME :\n  next line\r\nCustomer: x", [("name", "next line"), ("name", " x")], "NAME :\n  [NAME_1]\r\nCustomer:[NAME_2]"),
    # Letters of any script and raised digits bind; a joiner does not.
    ("\u00e8a@b.co \u00b2123456789 \u200d123456789", [("phone", "123456789")], "\u00e8a@b.co \u00b2123456789 \u200d[PHONE_1]"),
    ("12345-1234567-1 \u0661\u0662\u0663\u0664\u0665-\u0661\u0662\u0663\u0664\u0665\u0666\u0667-\u0661", [("cnic", "12345-1234567-1"), ("cnic", "\u0661\u0662\u0663\u0664\u0665-\u0661\u0662\u0663\u0664\u0665\u0666\u0667-\u0661")], "[CNIC_1] [CNIC_2]"),
    ("4111-1111-1111-1111 4111111111111112 0000 0000 0000 0000", [("card", "4111-1111-1111-1111")], "[CARD_1] 4111111111111112 0000 0000 0000 0000"),
    (
        "Project [A] and project [a] \\E (x) .* K Kelvin \u017f",
        [("custom", "Project [A]"), ("custom", "project [a]"), ("custom", "\\E"), ("custom", "(x) .*"), ("custom", "K"), ("custom", "K")],
        "[CUSTOM_1] and [CUSTOM_1] [CUSTOM_2] [CUSTOM_3] [CUSTOM_4] [CUSTOM_4]elvin \u017f",
    ),
    # Only a line feed or a carriage return ends a labelled value.
    ("name:ab\u0085name: cd\x0bname: ef name: gh", [("name", "ab\u0085name: cd\x0bname: ef name: gh")], "name:[NAME_1]"),
    ("patient: Bob\tname: none\naddress:     12345", [("name", "Bob\tname: none"), ("address", "12345")], "patient: [NAME_1]\naddress:     [ADDRESS_1]"),
    ("x@y.z a@b.c1 a..b@c.de @no.org me@host", [("email", "a..b@c.de")], "x@y.z a@b.c1 [EMAIL_1] @no.org me@host"),
    ("", [], ""),
]
LITERALS = ["Project [A]", "\\E", "K", "(x) .*"]


def test_texts_written_by_hand(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(BY_HAND)] + [(99, None)]
    out = D.redact(D.detect(spark.createDataFrame(rows, "doc_id long, text string"), literals=LITERALS)).collect()
    assert len(out) == len(rows)
    for r in out:
        _, found, redacted = BY_HAND[r.doc_id] if r.doc_id < 99 else ("", [], "")
        assert [(m.kind, r.text[m.start : m.end]) for m in r.spans] == found, r.text
        assert r.redacted == redacted


def check_digit(digits: str) -> str:
    """The digit that makes a card number's sum, with every other digit doubled from the right, end in zero."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        x = int(c) * (1 if place % 2 else 2)
        total += x // 10 + x % 10
    return str(-total % 10)


def iban(rng) -> str:
    account = "".join(rng.choices("0123456789", k=18))
    # 131400 stands for the letters D and E and the two digits that are sought.
    return f"DE{98 - int(account + '131400') % 97:02d}{account}"


def value(rng, kind: str, fine: bool) -> str:
    d = lambda n: "".join(rng.choices("123456789", k=n))
    if kind == "card":
        n = d(15)
        while len(set(n)) < 3:
            n = d(15)
        last = check_digit(n)
        return n + (last if fine else str((int(last) + 1) % 10))
    if kind == "iban":
        v = iban(rng)
        return v if fine else v[:-1] + str((int(v[-1]) + 1) % 10)
    if kind == "ipv4":
        # One octet out of range, and too few digits for a phone.
        four = [str(rng.randrange(256)) for _ in range(4)] if fine else [d(1), d(1), d(1), rng.choice(["256", "300", "01", "999"])]
        if not fine:
            rng.shuffle(four)
        return ".".join(four)
    if kind == "email":
        return f"{rng.choice(['a.b', 'x_1', 'q%'])}@{rng.choice(['h.org', 'sub.h.io'])}" if fine else rng.choice(["a@b", "@h.org", "a@.1", "a b@c"])
    if kind == "cnic":
        n = d(12)
        n += str((int(check_digit(n)) + 1) % 10)  # no card, which would win
        return f"{n[:5]}-{n[5:12]}-{n[12]}" if fine else f"{d(5)}-{d(6)}_{d(1)}"
    return rng.choice(["+1 (555) 123-4567", "030 1234567", "555.123.4567"]) if fine else rng.choice(["2024-01-02", "1999.12.31", "12345678", "555 12"])


def test_texts_made_of_known_values(spark):
    """Values that are fine, and others that miss their rule by a little, among words: the places of the first are the findings."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(600):
        text, found = "", []
        for _ in range(rng.randrange(1, 9)):
            kind, fine = rng.choice(["card", "iban", "ipv4", "email", "cnic", "phone"]), rng.random() < 0.6
            v = value(rng, kind, fine)
            # A number that misses its own rule may still look like a phone's, unless a letter stands before it.
            if not fine and kind in ("card", "iban", "cnic"):
                v = "x" + v.replace("-", "_")
            text += rng.choice(["word; ", "\u00e9t\u00e9 = ", "\n\u2014 "])
            if fine:
                found.append((kind, len(text), len(text) + len(v)))
            text += v + rng.choice([" ; ", "\n| ", " \u2014 "])
        rows.append((i, text))
        want[i] = found
    for r in D.redact(D.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert [(m.kind, m.start, m.end) for m in r.spans] == want[r.doc_id], r.text
        left, number = r.text, {}
        for kind, s, e in want[r.doc_id]:
            same = number.setdefault(kind, [])
            same += [r.text[s:e].casefold()] * (r.text[s:e].casefold() not in same)
        for kind, s, e in reversed(want[r.doc_id]):
            left = f"{left[:s]}[{kind.upper()}_{number[kind].index(r.text[s:e].casefold()) + 1}]{left[e:]}"
        assert r.redacted == left


def test_documents_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kinds = Counter(m.kind for r in D.detect(docs).collect() for m in r.spans)
    assert kinds == {"email": 5, "card": 6, "ipv4": 6, "phone": 6}


def test_kinds_and_literals_are_checked(spark):
    df = spark.createDataFrame([("a@b.org",)], "text string")
    assert D.detect(df, enabled=[]).first().spans == []
    assert [m.kind for m in D.detect(df, enabled=None).first().spans] == ["email"]
    with pytest.raises(InputError):
        D.detect(df, enabled=["nothing"])
    for bad in ([""], ["x" * 201], ["x"] * 31, "text"):
        with pytest.raises(InputError):
            D.detect(df, enabled=[], literals=bad)
    assert literals_of(" a \n\n b c") == ["a", "b", "c"]


def test_limits_reject_rows_and_strict_fails(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (2, "x" * 250_001), (3, "1.1.1.1 " * 6001)], "doc_id int, text string")
    got = {r.doc_id: r for r in D.detect(df).collect()}
    assert [got[i].error for i in (1, 2, 3)] == [None, "text_too_long", "too_many_candidates"]
    assert got[2].spans is None and got[1].spans
    with pytest.raises(Exception, match="text_too_long"):
        D.detect(df, strict=True).collect()


def test_reports_hold_no_values(spark):
    df = spark.createDataFrame([(1, "Name: Zyx Wvu a@b.org", "keep")], "doc_id int, text string, spans2 string")
    row = D.report(D.detect(df)).first()
    assert "Zyx" not in str(row) and "a@b.org" not in str(row)
    assert row.counts == {"email": 1, "name": 1} or row.counts == {"name": 1}
    assert row.findings == len(row.matches)


def test_redacted_text_holds_no_accepted_value(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = D.redact(D.detect(docs)).where(F.size("spans") > 0)
    left = out.select("doc_id", F.explode("spans.value").alias("v"), "redacted").where(F.contains("redacted", F.col("v")))
    assert left.count() == 0
    again = D.detect(out.select("doc_id", F.col("redacted").alias("text")))
    assert again.where(F.size("spans") > 0).count() == 0


def test_clean_refuses_partial_and_changed_sources(spark):
    df = spark.createDataFrame([(1, "a@b.org", True), (2, "a@b.org", False)], "doc_id int, text string, truncated boolean")
    assert [r.clean for r in D.clean(D.detect(df)).orderBy("doc_id").collect()] == [None, "[EMAIL_1]"]
    assert D.clean(D.detect(df), accept_partial=True).where("clean is null").count() == 0


def test_blocks_of_a_preview(spark):
    df = spark.createDataFrame([("[EMAIL_1] [PHONE_22] [OTHER_1]",)], "t string")
    assert df.select(S.blocks_of(F.col("t"))).first()[0] == "[REDACTED] [REDACTED] [OTHER_1]"
