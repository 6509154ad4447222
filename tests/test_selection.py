"""Bits, budgets, classification, interning, packets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from morphlake.functions import bits
from morphlake.operators import selection


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fnv(spark):
    words = ["", "a", "foobar", "éü", "x" * 40]

    def slow(t):
        h = bits.FNV_OFFSET
        for b in t.encode():
            h = (h ^ b) * bits.FNV_PRIME % 2**64
        return h - 2**64 if h >> 63 else h

    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["h"] for r in df.select("w", bits.fnv1a(F.col("w")).alias("h")).collect()} == {w: slow(w) for w in words}


def test_masks_and_fields(spark):
    df = spark.createDataFrame([("puella", ["N", "S", "N", "L", "L", "L"], 5, 300)], "w string, m array<string>, a int, b int")
    r = df.select(bits.mark_masks(F.col("w"), F.col("m")).alias("x"), bits.pack_fields([(F.col("a"), 4), (F.col("b"), 10)]).alias("p")).first()
    assert (r["x"]["known"], r["x"]["long"]) == (0b100010, 0b100000) and r["p"] == 5 | 300 << 4
    back = df.select(bits.pack_fields([(F.col("a"), 4), (F.col("b"), 10)]).alias("p")).select(*bits.unpack_fields(F.col("p"), [4, 10])).first()
    assert tuple(back) == (5, 300)
    with pytest.raises(Exception, match="fit"):
        df.select(bits.pack_fields([(F.col("b"), 4)])).collect()
    stems = spark.createDataFrame([("",), ("a",), ("aa",), ("az",), ("b",), ("zz",)], "s string")
    got = {r["s"]: r["b"] for r in stems.select("s", bits.stem_bucket(F.col("s")).alias("b")).collect()}
    assert got == {"": 0, "a": 1, "aa": 2, "az": 27, "b": 28, "zz": 702}


def test_budgets(spark):
    df = spark.createDataFrame([("g", k, c, s) for k, (c, s) in enumerate([(4, "a"), (5, "b"), (2, "a"), (3, "c"), (1, "d")])], "g string, k int, c int, s string")
    assert [r["k"] for r in selection.prefix_within(df, ["g"], ["k"], {"c": 9}).orderBy("k").collect()] == [0, 1]
    assert [r["k"] for r in selection.greedy_within(df, ["g"], ["k"], {"c": 10}, ["s"]).orderBy("k").collect()] == [0, 1, 4]


def test_interning_and_packets(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "t string, n int")
    coded, dictionary = selection.interned(df, "t", "tid")
    assert rows(dictionary) == [(0, "a"), (1, "b")] and sorted((r["n"], r["tid"]) for r in coded.collect() if r["tid"] is not None) == [(1, 1), (2, 0), (3, 1)]
    p = selection.packets(spark.createDataFrame([("k", 2, "y"), ("k", 1, "x")], "key string, n int, v string"), ["key"], ["n", "v"], ["n"])
    q = selection.packets(spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, n int, v string"), ["key"], ["n", "v"], ["n"])
    assert p.first()["revision"] == q.first()["revision"] and [m["n"] for m in p.first()["members"]] == [1, 2]


def test_logic(spark):
    df = spark.createDataFrame([("N", "N"), ("N", "G"), ("X", "G"), (None, "N")], "a string, b string")
    assert [r[0] for r in df.select(selection.compatibility(F.col("a"), F.col("b"))).collect()] == [True, False, None, None]
    sets = spark.createDataFrame([([1], [1]), ([1], [1, 2]), ([1, 2], [1]), ([1, 2], [2, 3]), ([1], [2])], "a array<int>, b array<int>")
    assert [r[0] for r in sets.select(selection.relation_of_sets(F.col("a"), F.col("b"))).collect()] == ["same", "subset", "superset", "overlap", "disjoint"]
    a, b = spark.createDataFrame([(1, "t1"), (1, "t1")], "x int, at string"), spark.createDataFrame([(1, "t2"), (2, "t2")], "x int, at string")
    assert rows(selection.differences(a, b, ["at"])) == [(1, "left"), (2, "right")]
    n = lambda x: F.lit(x)
    q = selection.corpus_queue(n(9), n(10), n(0), n(0), n(9), n(0), n(False), n(False))
    assert spark.range(1).select(q).first()[0] == "proper_name"
