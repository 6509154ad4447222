"""Precedence, ranks, votes, graphs, trees, readers and writers on tiny tables."""

from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.functions import text, vectors
from morphlake.operators import graph, precedence, ranking, resolve, search, trees, votes
from morphlake.sources import rulefiles, sinks
from morphlake.streaming import lines as streaming


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_precedence(spark):
    a = spark.createDataFrame([("x", 2, "p"), ("x", 1, "q"), ("x", 1, "r"), ("y", 3, "s")], "w string, rule int, v string")
    b = spark.createDataFrame([("x", 9, "t"), ("z", 9, "u")], "w string, rule int, v string")
    assert rows(precedence.first_success(a, ["w"], ["rule"])) == [("x", 1, "q"), ("x", 1, "r"), ("y", 3, "s")]
    assert [r[0] for r in rows(precedence.fallback([a, b], ["w"]))] == ["x", "x", "x", "y", "z"]
    assert rows(precedence.override(a, b, ["w"])) == [("x", 9, "t"), ("y", 3, "s"), ("z", 9, "u")]
    kept = precedence.override(a, b, ["w"], weak=F.col("rule") > 1)
    assert [r[0] for r in rows(kept)] == ["x", "x", "x", "y", "z"]


def test_margins_of_ties(spark):
    p = spark.createDataFrame([("a", "1", 0.5), ("a", "2", 0.5), ("a", "3", 0.2), ("b", "1", 0.7)], "l string, r string, score double")
    got = {(r["l"], r["r"]): (r["competition_rank"], round(r["margin"], 6)) for r in ranking.rank_with_margin(p, ["l"], "score", "r").collect()}
    assert got == {("a", "1"): (1, 0.0), ("a", "2"): (1, 0.5), ("a", "3"): (3, -0.3), ("b", "1"): (1, 0.7)}


def test_votes(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (4, None), (5, "a"), (5, "a"), (5, "b"), (5, "b")], "k int, v string")
    got = {r["k"]: (r["status"], r["winner"]) for r in votes.majority(v, ["k"], "v").collect()}
    assert got == {1: ("majority", "a"), 2: ("agreement", "a"), 3: ("conflict", None), 4: ("unknown", None), 5: ("conflict", None)}
    f = spark.createDataFrame([(1, "f", "a"), (1, "f", "b"), (1, "g", "a"), (1, "h", "a")], "k int, fam string, v string")
    assert votes.family_vote(f, ["k"], "fam", "v").select("status", "winner", "n_families").first() == ("majority", "a", 2)


def test_graph(spark):
    e = spark.createDataFrame([(5, 3), (3, 9), (1, 2), (7, 7), (20, 9)], "u long, v long")
    assert rows(graph.components(e)) == [(2, 1), (5, 3), (9, 3), (20, 3)]
    assert rows(graph.closure(spark.createDataFrame([(5,)], "u long"), e)) == [(3,), (5,), (9,)]
    n = 200
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)], "u long, v long")
    assert graph.components(chain).where("component = 0").count() == n
    assert graph.components(e.limit(0)).count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(2, 6))
        s = rng.normal(size=(n, n)).round(2)
        s[:, 0] = trees.NONE
        np.fill_diagonal(s, trees.NONE)
        best = trees.exact_tree(s)
        assert trees.score_of(trees.spanning_tree(s), s) == pytest.approx(trees.score_of(best, s))
        flat = trees.projective_tree(s)
        spans = [(min(h, d), max(h, d)) for d, h in enumerate(flat) if d and h]
        assert not any(a < c < b < d for a, b in spans for c, d in spans) and flat[1:].count(0) == 1
        assert trees.score_of(flat, s) <= trees.score_of(best, s) + 1e-9


def test_decode(spark):
    arcs = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 0, 2, 0.5), (1, 2, 1, 0.1), (2, 0, 1, 1.0)], "sentence long, head int, dependent int, score double")
    for name in trees.DECODERS:
        assert rows(trees.decode(arcs, name)) == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_resolution(spark):
    nodes = spark.createDataFrame([("p", "a", "f"), ("p", "b", "g"), ("p", "c", "f"), ("p", "d", "h"), ("q", "e", "f")], "packet string, node string, family string")
    edges = spark.createDataFrame([("p", "a", "b", 0.9), ("p", "b", "c", 0.8), ("p", "c", "d", 0.7)], "packet string, left string, right string, score double")
    assert rows(resolve.family_components(nodes, edges)) == [("p", "a", "a"), ("p", "b", "a"), ("p", "c", "c"), ("p", "d", "c"), ("q", "e", "e")]
    gold = spark.createDataFrame([(0.9, 0.1, True), (0.8, 0.05, True), (0.7, 0.0, False), (0.6, 0.2, True)], "score double, margin double, same boolean")
    best = resolve.calibrate(gold).first()
    want = max(((tp / 3, tp / n, -t, -g) for t in range(101) for g in range(21) if (n := sum(s >= t / 100 and m >= g / 100 for s, m, _ in GOLD)) and (tp := sum(y and s >= t / 100 and m >= g / 100 for s, m, y in GOLD)) / n >= 0.995))
    assert (round(best["recall"], 6), round(best["threshold"] * 100), round(best["margin"] * 100)) == (round(want[0], 6), -want[2], -want[3])
    pairs = resolve.blocked_pairs(spark.createDataFrame([("k", "1", "f"), ("k", "2", "f"), ("k", "3", "g"), ("j", "4", "g")], "key string, ref string, family string"), ["key"], spark.createDataFrame([("4", "1"), ("3", "1")], "ref string, other string"))
    assert rows(pairs) == [("1", "3"), ("1", "4"), ("2", "3")]


GOLD = [(0.9, 0.1, True), (0.8, 0.05, True), (0.7, 0.0, False), (0.6, 0.2, True)]


def test_arc_consistency(spark):
    domains = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("z", 2)], "node string, value int")
    less = [("c", a, u, b, v) for a, b in (("x", "y"), ("y", "z")) for u in (1, 2) for v in (1, 2) if u < v]
    both = less + [(c, b, v, a, u) for c, a, u, b, v in less]
    both = [(f"{min(a, b)}{max(a, b)}", a, u, b, v) for _, a, u, b, v in both]
    assert search.prune_to_support(domains, spark.createDataFrame(both, "constraint string, node string, value int, other string, other_value int")).count() == 0
    ok = [("xy", "x", 1, "y", 2), ("xy", "y", 2, "x", 1)]
    left = search.prune_to_support(domains, spark.createDataFrame(ok, "constraint string, node string, value int, other string, other_value int"))
    assert rows(left) == [("x", 1), ("y", 2), ("z", 2)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\tb  " + "x" * 300, "Æneas jvat", "a\x00b")], "a string, b string, c string")
    got = df.select(text.bounded_witness(F.col("a")), text.fold_letters(F.col("b")), text.safe_text(F.col("c")), text.expand_ligatures(F.lit("cæœ"))).first()
    assert len(got[0]) == 180 and got[0].endswith("…") and got[0].startswith("a b xx") and got[1] == "æneas iuat" and got[2] == "a b" and got[3] == "caeoe"
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(vectors.normalized(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in v] == [[0.6, 0.8], None, None]


def test_rule_files(spark, tmp_path):
    files = {
        "addons": "-- a comment\nPREFIX ad\nX X\nto\nPREFIX ec\nPACK PACK\nis there any\nSUFFIX atic\nN 2 ADJ 1 1 POS 0\nmade of\nTACKON que\nX\nand\nPACKON dam\nPRON 1 0\ncertain\n",
        "uniques": "agatur\nV 3 1 PRES PASSIVE SUB 3 S IMPERS F X X E E\nlet it be\n", "rewrites": "SYNCOPE 1 MAIN LITERAL INTERNAL REVERSE as avis V 3 0 1 ANY CLASSICAL perfect\ngloss\n",
        "quantities": "INFLECTION 72 3 0\nSTEM 5 2 4 4\nSUFFIX 9 1 1\n", "inflections": "N 1 1 NOM S C 1 1 a X A\nV 1 1 PRES ACTIVE IND 3 S 2 2 at X A -- note\nCONJ 1 0 X A\n", "notices": "5 SOME_TRIGGER SOME_NOTICE\n", "packons": "7 cumque\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    prefixes, suffixes, tackons = rulefiles.read_addons(spark, str(tmp_path / "addons"))
    assert rows(prefixes.select("addon_id", "fix", "tickon")) == [(0, "ad", False), (1, "ec", True)]
    assert rows(suffixes.select("addon_id", "fix", "root_pos", "root_key", "target_pos", "target_decl", "target_degree", "target_key")) == [(2, "atic", "N", 2, "ADJ", 1, "POS", 0)]
    assert rows(tackons.select("addon_id", "fix", "enclitic", "packon")) == [(3, "que", True, False), (4, "dam", False, True)]
    assert rulefiles.read_uniques(spark, str(tmp_path / "uniques")).select("surface", "tense", "person", "number").first() == ("agatur", "PRES", 3, "S")
    assert rulefiles.read_rewrites(spark, str(tmp_path / "rewrites")).select("before", "after", "reverse", "required_key", "medieval").first() == ("as", "avis", True, 3, False)
    assert rows(rulefiles.read_quantities(spark, str(tmp_path / "quantities"))) == [("INFLECTION", 72, 0, 3, 0), ("STEM", 4, 2, 4, 4), ("SUFFIX", 9, 0, 1, 1)]
    assert rows(rulefiles.read_inflections(spark, str(tmp_path / "inflections")).select("rule_id", "rule_pos", "rule_key", "ending", "tense", "person")) == [(0, "N", 1, "a", "X", 0), (1, "V", 2, "at", "PRES", 3), (2, "CONJ", 1, "", "X", 0)]
    assert rulefiles.read_notices(spark, str(tmp_path / "notices")).first() == (4, "some_trigger", "some_notice")
    assert rulefiles.read_packon_requirements(spark, str(tmp_path / "packons")).first() == (6, "cumque")
    (tmp_path / "broken").write_text("SYNCOPE 1 MAIN\ngloss\n")
    with pytest.raises(Exception, match="fifteen"):
        rulefiles.read_rewrites(spark, str(tmp_path / "broken")).collect()
    (tmp_path / "bin").write_bytes(b"ab  1 cd  2 ")
    assert rows(rulefiles.read_fixed_width(spark, str(tmp_path / "bin"), 6, {"stem": (0, 4), "key": (4, 2)})) == [(0, "ab", "1"), (1, "cd", "2")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    sinks.write_table(df, str(tmp_path / "t"), ["k"], gzip=True)
    assert rows(rulefiles.read_table(spark, str(tmp_path / "t"), "k string, n long", ["k"])) == [("a", 1), ("b", 2)]
    sinks.write_table(df.union(df), str(tmp_path / "u"), ["k"])
    with pytest.raises(ValueError, match="twice"):
        rulefiles.read_table(spark, str(tmp_path / "u"), "k string, n long", ["k"])
    new = spark.createDataFrame([("a", 9), ("c", 3)], "k string, n long")
    assert rows(sinks.merged(df, new, ["k"])) == [("a", 9), ("b", 2), ("c", 3)] and rows(sinks.inserted(df, new, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]
    sinks.replace_partitions(df, str(tmp_path / "p"), "k")
    sinks.replace_partitions(new, str(tmp_path / "p"), "k")
    assert {(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    with gzip.open(tmp_path / "j.jsonl.gz", "wt") as f:
        f.write('{"schema": "s1", "x": 1}\n')
    assert rulefiles.read_tagged_json(spark, str(tmp_path / "j.jsonl.gz"), "schema string, x int", "s1").first()["x"] == 1
    with pytest.raises(Exception, match="another schema"):
        rulefiles.read_tagged_json(spark, str(tmp_path / "j.jsonl.gz"), "schema string, x int", "s2").collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Puella amat.\r\n\nrosam\n")
    stream = streaming.stream_tokens(streaming.read_lines(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["lookup"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["amat", "puella", "rosam"]
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 01:10:00", "a", 2.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert streaming.windowed_counts(events, "1 hour", "1 hour").count() == 2
