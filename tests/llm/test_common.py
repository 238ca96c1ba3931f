"""Components of random graphs, and the registered queries' oracles."""

import random

import duckdb
import pytest

from veilspark.llm import queries
from veilspark.llm.common import Stash, components


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (60, 80), (200, 199)):
        edges = [(i, i + 1) for i in range(m)] if n == 200 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n + 1))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
        got = components(spark.createDataFrame([*edges, edges[0], (None, 1)], "a long, b long"), Stash(spark, "test"))
        assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), Stash(spark, "test")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries.queries()[name](spark, d)
    cols = sorted(df.columns)
    res = con.execute(queries.oracle_sql()[name])
    have = [c[0] for c in res.description]
    assert sorted(have) == cols
    near = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    got = sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(near(r[have.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_drivers_heap_is_given_back(spark):
    """Garbage is collected where the heap takes more than its share, and not before."""
    from veilspark.llm.common import trim_driver

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(b.getCollectionCount() for b in beans)
    before = runs()
    assert not trim_driver(spark, 1.0) and trim_driver(spark, 0.0)
    assert runs() > before
