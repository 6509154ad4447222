"""Recognizers against derivation by spans, headwords and models against small cases."""

from __future__ import annotations

import math
from functools import cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from morphlake.operators import hits, recognize, structure

GRAMMARS = {
    "clause": recognize.clause_grammar("ab", "b"),
    "fragment": recognize.clause_grammar("ab", "b", fragment=True),
    "mirror": [("M", ("a", "M", "a")), ("M", ("b", "M", "b")), ("M", ("a",)), ("M", ())],
    "ambiguous": [("S", ("S", "S")), ("S", ("a",)), ("S", ()), ("S", ("b", "S", "b"))],
    "hidden left": [("S", ("E", "S", "b")), ("S", ("a",)), ("E", ()), ("E", ("a",))],
    "empty on the right": [("S", ("a", "T", "E")), ("T", ("S",)), ("T", ()), ("E", ()), ("E", ("b", "E"))],
    "circle": [("S", ("T",)), ("T", ("S",)), ("T", ("a", "b"))],
    "none": [("S", ("S", "a"))],
}


def derives(grammar, symbols):
    """By the smallest fixed point over (symbol, from, to)."""
    left, n = {a for a, _ in grammar}, len(symbols)
    found = {(x, k, k + 1) for k, x in enumerate(symbols)}

    def ends(right, at):
        return {at} if not right else {e for m in range(at, n + 1) if (right[0], at, m) in found for e in ends(right[1:], m)}

    while new := {(a, i, e) for a, right in grammar for i in range(n + 1) for e in ends(right, i)} - found:
        found |= new
    assert left
    return (grammar[0][0], 0, n) in found


@pytest.mark.parametrize("name", GRAMMARS)
def test_recognizers_against_spans(name):
    grammar = GRAMMARS[name]
    table = recognize.Table(grammar)
    for n in range(6):
        for s in product("ab", repeat=n):
            want = derives(grammar, s)
            assert (recognize.earley(grammar, s), recognize.glr(table, s)) == (want, want), s


def test_sequences_of_rows(spark):
    rows = [(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["a", "b"]), (6, ["c"])]
    out = recognize.recognized(spark.createDataFrame(rows, "id long, s array<string>"), "s", {"clause": GRAMMARS["clause"]})
    assert sorted((r["id"], r["clause_earley"], r["clause_glr"]) for r in out.collect()) == [(k, k in (1, 5), k in (1, 5)) for k in range(1, 7)]


def test_headwords(spark):
    want = {
        "3 ā, ăb, abs": ("a", "L", False), "cŏrō^na": None, "Rōma": ("roma", ".L..", True), "rōma urbs": None, "roma": None, "": None, "12": None, "rōmă.": ("roma", ".L.S", False),
        "ro\u0304ma": ("roma", ".L..", False), "ro\u0301ma\u0304": None, "ñōs": None, "ā-b": None, "ā -b": ("a", "L", False), "ā\u0306": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "lemma string")
    got = {r["lemma"]: None if r["letters"] is None else (r["letters"], r["marks"], r["capital"]) for r in df.select("lemma", *[c.alias(n) for n, c in hits.marked_headword(F.col("lemma")).items()]).collect()}
    assert got == want
    assert df.select(hits.marked_headword(F.lit("roma"), require_quantity=False)["marks"]).first()[0] == "...."


def test_tags(spark):
    rows = [("NOUN", " subst ", "compatible"), ("NOUN", "V", "conflict"), ("X", "V", "unknown"), (None, "V", "unknown"), ("ADP", "preposition", "compatible"), ("NUM", "A", "compatible"), ("VERB", None, "unknown"), ("VERB", " ", "unknown")]
    df = spark.createDataFrame(rows, "u string, d string, want string")
    assert df.where(hits.pos_assessment(F.col("u"), F.col("d")) != F.col("want")).count() == 0


def test_hits_without_a_lexeme_stand_alone(spark):
    df = spark.createDataFrame([(1, 1, 7), (1, 2, None), (1, 3, 7), (1, 4, None), (1, 5, 3)], "q int, place int, lexeme int")
    out = {r["group_no"]: (r["lexeme"], r["places"]) for r in hits.group_hits(df, "q", "place", "lexeme").collect()}
    assert out == {1: (7, [1, 3]), 2: (None, [2]), 3: (None, [4]), 4: (3, [5])}


def test_structural_scores_by_hand(spark):
    rows = [(1, 1, None, "r", "V"), (1, 2, 1, "s", "N"), (1, 3, 2, "m", "A"), (2, 1, None, "r", "V"), (2, 2, 1, "o", "N")]
    t = spark.createDataFrame(rows, "tree int, token int, head int, label string, state string")
    f = structure.factors(t, "tree", F.col("state") == "V")
    got = sorted((r["tree"], r["kind"], r["c1"], r["c2"], r["event"]) for r in f.select(*["tree", "kind", F.coalesce("c1", F.lit("")).alias("c1"), F.coalesce("c2", F.lit("")).alias("c2"), "event"]).collect())
    assert got == sorted([
        (1, "root", "", "", "V"), (2, "root", "", "", "V"), (1, "arc", "V", "<ROOT>|root|V", "s:N"), (1, "arc", "N", "V|s|N", "m:A"), (2, "arc", "V", "<ROOT>|root|V", "o:N"),
        (1, "profile", "V", "", "s:N"), (2, "profile", "V", "", "o:N"),
    ])

    @cache
    def arc(n0, *levels):
        p = (n0 + 0.1) / (3 + 0.1 * 4)
        for n, total in levels:
            p = (n + p) / (total + 1)
        return p

    profile = (1 + (1 + 0.1) / (2 + 0.1 * 3)) / (2 + 1)
    want = math.log((2 + 0.1) / (2 + 0.1 * 2)) + math.log(arc(1, (1, 2), (1, 2))) + math.log(arc(1, (1, 1), (1, 1))) + math.log(profile)
    s = {r["tree"]: r for r in structure.scores(f, f, "tree").collect()}
    assert s[1]["factors"] == 4 and math.isclose(s[1]["log_score"], want)
    other = spark.createDataFrame([(9, 1, None, "r", "Q"), (9, 2, 1, "s", "N")], "tree int, token int, head int, label string, state string")
    unknown = structure.scores(structure.factors(other, "tree", F.col("state") == "V"), f, "tree").first()
    assert math.isclose(unknown["log_score"], math.log(0.1 / 2.2) + math.log(arc(1)))  # a context not seen backs off


def test_controls_keep_the_states(spark):
    t = spark.range(20).selectExpr("id % 2 as tree", "cast(id / 2 as int) as token", "cast(null as int) as head", "'x' as label", "cast(id as string) as state")
    c = structure.shuffled(t, "tree", "s")
    key = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert key(c, "tree", "state") == key(t, "tree", "state") and key(c, "tree", "token") == key(t, "tree", "token")
    assert key(c, "tree", "token", "state") != key(t, "tree", "token", "state") and key(c, "tree", "token", "state") == key(structure.shuffled(t, "tree", "s"), "tree", "token", "state")
