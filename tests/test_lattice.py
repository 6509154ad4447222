"""Lattice edges, assignments and hard rules against enumeration."""

from __future__ import annotations

from itertools import product

from morphlake.operators import lattice

ROWS = [
    (1, 0, 0, "N", "NOM", "S", "F", None, None, None, None), (1, 0, 1, "N", "ABL", "S", "F", None, None, None, None),
    (1, 1, 0, "PREP", None, None, None, None, None, "ABL", None), (1, 2, 0, "N", "ABL", "S", "F", None, None, None, None), (1, 2, 1, "N", "ACC", "P", "F", None, None, None, None),
    (1, 3, 0, "V", None, "S", None, 3, "IND", None, None), (1, 3, 1, "V", None, "P", None, 3, "IND", None, None), (1, 3, 2, "N", "X", "S", "M", None, None, None, None),
    (2, 0, 0, "N", "NOM", "S", "M", None, None, None, "que"), (2, 1, 0, "V", None, "S", None, 3, "IND", None, None),
]


def slow(rows):
    """The first rule that each choice breaks."""
    out = {}
    for s in {r[0] for r in rows}:
        tokens = sorted({r[1] for r in rows if r[0] == s})
        for choice in product(*[[r for r in rows if r[0] == s and r[1] == t] for t in tokens]):
            finite = [r for r in choice if r[3] == "V" and r[8] in ("IND", "SUB", "IMP")]
            subjects = [r for r in choice if r[4] == "NOM" and r[3] in ("N", "PRON")]
            thirds = {r[5] for r in finite if r[7] == 3}
            lone = any(p[3] == "PREP" and not any(n[1] > p[1] and n[3] in lattice.NOMINAL and n[4] in (p[9], "X", None) for n in choice) for p in choice)
            que = any(q[10] == "que" and not any(e[1] < q[1] and e[3] == q[3] and e[4] in (q[4], "X", None) for e in choice) for q in choice)
            rule = "H002" if not finite else "H003" if len(subjects) == 1 and thirds and subjects[0][5] not in thirds else "H005" if lone else "H007" if que else None
            out[s, tuple(r[2] for r in choice)] = rule
    return out


def test_hard_rules(spark):
    df = spark.createDataFrame(ROWS, lattice.CANDIDATE)
    edges = lattice.relation_edges(df)
    chosen = lattice.assignments(df, 100)
    checked = lattice.violations(chosen, df, edges)
    picks = {}
    for r in chosen.collect():
        picks.setdefault((r["sentence"], r["assignment"]), {})[r["token"]] = r["cand"]
    got = {(r["sentence"], tuple(c for _, c in sorted(picks[r["sentence"], r["assignment"]].items()))): r["violation"] for r in checked.collect()}
    assert got == slow(ROWS)
    digest = {r["sentence"]: r["survivors"] for r in lattice.survivor_digest(checked).collect()}
    assert digest.get(1) == sum(v is None and s == 1 for (s, _), v in got.items()) and 2 not in digest
    assert {r["sentence"] for r in lattice.assignments(df, 5).select("sentence").distinct().collect()} == {2}


def test_three_values(spark):
    df = spark.createDataFrame(ROWS, lattice.CANDIDATE)
    found = {(r["gov_token"], r["dep_token"], r["dep_cand"]): r["compatible"] for r in lattice.relation_edges(df).where("sentence = 1 and relation = 'complement'").collect()}
    assert found == {(1, 2, 0): True, (1, 2, 1): False, (1, 3, 2): None}
