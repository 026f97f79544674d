"""Components and split joins against plain Python."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import components as C

EDGES = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 5), (9000, 9001), (9001, 399), (77, 78), (88888, 88888), (7, 7), (None, 3), (4, None)]


def brute(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("share", [1e-3, 1.0])  # almost every centre is hot; none is
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(C, "HOT_SHARE", share)
    got = C.connected_components(spark.createDataFrame(EDGES, "x long, y int"), "x", "y").collect()
    assert {r.node: r.component for r in got} == brute(EDGES) and len(got) == len(brute(EDGES))
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_split(spark, how):
    rows = spark.createDataFrame([(i % 5 if i < 50 else 99, i, i) for i in range(60)] + [(1, 1, -1)] * 3, "k long, value long, n long")
    keyed = spark.createDataFrame([(k, k * 10, 13 if k == 1 else 10) for k in range(5)], "k long, twice long, n_rows long")
    want = sorted(map(tuple, rows.join(keyed.drop("n_rows"), "k", how).collect()), key=str)
    for limit in (0, 11, 100):
        got = C.join_split(rows, keyed, ["k"], "n_rows", limit, F.xxhash64("value"), how)
        assert got.columns == ["k", "value", "n", "twice"] and sorted(map(tuple, got.collect()), key=str) == want


def test_a_cut_deletes_its_shuffles_and_restores_the_switch(spark):
    before = spark.conf.get(C.CLEANUP, None)
    df = C.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert df.count() == 7 and spark.conf.get(C.CLEANUP, None) == before
