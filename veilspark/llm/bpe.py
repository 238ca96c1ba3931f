"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match over the vocabulary. A
proposal is the exact BPE result if no merge rule can act across any of its
boundaries, which is a test of adjacent pairs alone; all pairs of all new words
of a batch are tested together in numpy. Only words with a failing pair are
merged rule by rule.

Nulls and empty texts encode to no tokens; an empty table gives an empty table.
Decoding ids that were encoded from a text gives that text back. Texts are
encoded whole, and a word of any length costs its length times a logarithm.
Among rules that could act, the lowest acts first, and of its places the first.
Rows that repeat are encoded each, and alike. Other columns pass as they are;
own columns called n_tokens, ids_sha256 or decoded_sha256 are left out.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, release, small_batches, unpacked

#: Fixed: the split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 40
#: Bytes of a word from which on its merges are kept in a heap: the result is the same.
LONG_WORD = 200
#: Words remembered by a Python worker; beyond it the memory starts anew, which costs time only.
REMEMBERED = 300_000


def byte_names() -> dict[str, int]:
    """Printable stand-ins of the 256 byte values in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Tables of one vocabulary file, given as its JSON text."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model, names = spec["model"], byte_names()
        self.bytes_of = {i: bytes(names[c] for c in s) for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        top = max(self.bytes_of) + 1
        self.rank = np.full(top, -1, np.int64)  # of the rule that makes a token; -1: a single byte
        self.left, self.right = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.rules: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        vocab = model["vocab"]
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rules[x, y] = n
            self.made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = n, x, y
        keys = np.array([(x << 32) | y for x, y in self.rules], np.int64)
        ranks = np.array(list(self.rules.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.single = [0] * 256
        for i, s in self.bytes_of.items():
            if len(s) == 1:
                self.single[s[0]] = i
        # A token that its own bytes do not merge to can never be proposed.
        self.token = {s: i for i, s in self.bytes_of.items() if len(s) == 1 or self.merge(s) == [i]}
        self.reach: dict[bytes, int] = {}  # length of the longest token by its first two bytes
        for t in self.token:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.split = regex.compile(SPLIT)
        self.text_of = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.name = {i: str(i) for i in self.text_of}
        self.named = {n: self.text_of[i] for i, n in self.name.items()}
        self.known: dict[str, str] = {}  # word -> its ids, joined by commas
        self.verified = self.merged = 0

    def merge(self, s: bytes) -> list[int]:
        """Exact result: the first pair of the lowest rule is merged, again and again."""
        if len(s) > LONG_WORD:
            return self.merge_long(s)
        ids, get, made = [self.single[b] for b in s], self.rules.get, self.made
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) != NEVER:
            k = ranks.index(r)
            ids[k : k + 2] = [made[r]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), NEVER)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), NEVER)
        return ids

    def merge_long(self, s: bytes) -> list[int]:
        """As merge, with the pairs in a heap by rule and place, and links between the pieces that are left: a step costs a logarithm."""
        ids, get, made, n = [self.single[b] for b in s], self.rules.get, self.made, len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(p, NEVER)) != NEVER]
        heapify(heap)
        place = (1 << 40) - 1
        while heap:
            top = heappop(heap)
            i, r = top & place, top >> 40
            j = after[i]
            # A piece that is gone is -1, and no rule has it; a piece that has changed has another rule.
            if j >= n or get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get((ids[i], ids[k]), NEVER)) != NEVER:
                    heappush(heap, x << 40 | i)
            h = before[i]
            if h >= 0 and (x := get((ids[h], ids[i]), NEVER)) != NEVER:
                heappush(heap, x << 40 | h)
        return [i for i in ids if i >= 0]

    def propose(self, s: bytes) -> list[int]:
        out, i, n, token, reach = [], 0, len(s), self.token, self.reach
        while i < n:
            j = min(n, i + reach.get(s[i : i + 2], 1))
            while (t := token.get(s[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the boundary of each pair (a, b) stays, in one pass over all pairs.

        The merges that made a and b are undone, latest first. A rule that joins
        the two pieces at the boundary before the undone merge would have acted
        would have been chosen instead.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(live):
            bad = self.rank_of(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb  # at equal rank the left one was made first, so the right one goes first
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def learn(self, words: set[str]) -> None:
        """Remember the tokens of new words."""
        raw = [w.encode() for w in words]
        made = [self.propose(s) for s in raw]
        size = np.array([len(m) for m in made], np.int64)
        flat = np.fromiter((t for m in made for t in m), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(made)), size)
        inner = of[:-1] == of[1:]
        pairs, back = np.unique((flat[:-1][inner] << 32) | flat[1:][inner], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        failed = set(of[:-1][inner][~good].tolist())
        self.verified += len(made) - len(failed)
        self.merged += len(failed)
        for k, (w, s, m) in enumerate(zip(words, raw, made, strict=True)):
            if k in failed:
                m = self.merge(s)
            self.known[w] = ",".join([self.name[i] for i in m])

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by commas."""
        cut, known = [self.pieces(t) for t in texts], self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*cut)
        for s in new & self.special.keys():
            known[s] = self.name[self.special[s]]
        if new := new - self.special.keys():
            self.learn(new)
        return [",".join([known[w] for w in ws]) for ws in cut]

    def encode(self, text: str) -> list[int]:
        return ids_of(self.encode_all([text])[0])

    def decode_joined(self, ids: str) -> str:
        """The text of ids joined by commas; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.named.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


def ids_of(joined: str) -> list[int]:
    return list(map(int, joined.split(","))) if joined else []


_LOADED: dict[bytes, ByteBPE] = {}


def loaded(spec: bytes) -> ByteBPE:
    """One set of tables a Python worker."""
    key = hashlib.sha256(spec).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(spec)
    return _LOADED[key]


#: Texts of one numpy batch: up to this many characters together, or one longer text.
BATCH_CHARS = 2_000_000


def batches(texts):
    held, size = [], 0
    for t in texts:
        t = t or ""
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoder(spark: SparkSession, path: str):
    """UDF text -> array of token ids. The vocabulary file (fixed, under 2 MB) is broadcast."""
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe, out = loaded(spec.value), []
        for held in batches(texts):
            out += [np.array(ids_of(ids), dtype=np.int32) for ids in bpe.encode_all(held)]
        return pd.Series(out, dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """UDF array of token ids -> text; invalid UTF-8 becomes U+FFFD; null stays null."""
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = loaded(spec.value)
        return pd.Series([None if x is None else bpe.decode(x.tolist() if hasattr(x, "tolist") else x) for x in ids], dtype=object)

    return decode


def digests(spark: SparkSession, path: str):
    """UDF text -> (n_tokens, ids_sha256, decoded_sha256): encode, decode what was encoded, and digest both, without sending ids to the JVM."""
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = loaded(spec.value), []
        for held in batches(texts):
            for ids in bpe.encode_all(held):
                text = bpe.decode_joined(ids)
                rows.append((ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        release()
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def with_digests(docs: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """Documents with n_tokens, ids_sha256 and decoded_sha256 after their own columns."""
    spark = docs.sparkSession
    small_batches(spark)
    col = F.col(text) if isinstance(text, str) else text
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    out = carried(docs, bpe=digests(spark, path).asNondeterministic()(col))
    return out.select(*unpacked(out, *names), *[f"bpe.{n}" for n in names])
