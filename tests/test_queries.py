"""Every registered query against its oracle SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from veilspark import queries as Q

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = Q.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(Q.oracle_sql()[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    want = Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["lsa_search", "corpus_fingerprint"])
def test_query_without_oracle_runs(spark, name):
    assert Q.queries()[name](spark, DIR).count() > 0


def test_every_query_is_listed():
    assert set(Q.oracle_sql()) <= set(Q.queries())
