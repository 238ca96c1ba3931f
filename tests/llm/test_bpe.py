"""Encoding against the tokenizers library, on texts chosen to be awkward."""

import hashlib
import random
import time

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from veilspark.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        return bpe.ByteBPE(f.read())


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["\U0001f600", "\U00020000"]
    for k in range(1500):
        yield "".join(rng.choice(chars) for _ in range(rng.randrange(30)))
        yield "".join(rng.choice("abcdefghij the ing's!!! \n\t12") for _ in range(rng.randrange(60)))
        yield "x<|endoftext|>" * (k % 3) + "".join(rng.choice("\x1c\x1f\x85\xa0\u2003\u200b  \n\r\tab") for _ in range(12))


def test_ids_and_round_trip(ours, theirs):
    every = list(texts())
    want = theirs.encode_batch(every, add_special_tokens=False)
    for t, got, w in zip(every, ours.encode_all(every), want, strict=True):
        assert bpe.ids_of(got) == w.ids, t
        assert ours.decode_joined(got) == ours.decode(w.ids) == theirs.decode(w.ids, skip_special_tokens=False) == t
    assert ours.verified and ours.merged  # both ways are taken


def test_every_token_is_its_own_encoding(ours):
    assert len(ours.token) == len(ours.bytes_of)


def test_pair_checks_agree_with_merging(ours):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    ok = ours.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        assert (ours.merge(ours.bytes_of[x] + ours.bytes_of[y]) == [x, y]) == good


def test_forgetting_changes_nothing(ours, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    some = list(texts())[:60]
    first = [ours.encode(t) for t in some]
    monkeypatch.setattr(bpe, "REMEMBERED", 10**6)
    assert [ours.encode(t) for t in some] == first


def test_query_edges(spark, theirs):
    rows = [(1, "Hello world, hello!", "a", 9), (2, None, "b", 9), (3, "", "c", 9), (None, "é <|endoftext|>", "d", 9), (4, "word " * 30_000, "e", 9), (4, "word " * 30_000, "e", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, bpe int")
    out = bpe.with_digests(df, PATH).collect()
    assert len(out) == 6
    for r in out:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.with_digests(df.limit(0), PATH).count() == 0


def test_encode_and_decode_columns(spark, theirs):
    df = spark.createDataFrame([("one two",), (None,)], "text string")
    ids = df.select(bpe.encoder(spark, PATH)("text").alias("ids"))
    assert ids.collect()[0].ids == theirs.encode("one two", add_special_tokens=False).ids
    assert [r[0] for r in ids.select(bpe.decoder(spark, PATH)("ids")).collect()] == ["one two", ""]


@pytest.mark.parametrize("word", ["abcdefghijklmnopqrstuvwxyz", "0123456789", "\u6f22\u5b57\u6587\u66f8\u65e5\u672c\u8a9e", "=", "ab", "1a="])
def test_long_words(ours, theirs, word):
    """A word of any length: as the library has it, in time that does not grow with its square."""
    rng = random.Random(len(word))
    short = "".join(rng.choice(word) for _ in range(5000))
    assert ours.encode(short) == theirs.encode(short, add_special_tokens=False).ids
    long = "".join(rng.choices(word, k=1_000_000 // len(word[0].encode())))
    began = time.time()
    ids = ours.encode(long)
    assert time.time() - began < 15 and ours.decode(ids) == long


def test_both_ways_of_merging(ours):
    rng = random.Random(8)
    for _ in range(300):
        s = "".join(rng.choice("aab thei\u00e9n==12") for _ in range(rng.randrange(1, 180))).encode()
        assert ours.merge(s) == ours.merge_long(s)
