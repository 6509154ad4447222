"""Queries against brute force over all rows, where their SQL leaves rows out or there is none."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from morphlake.operators import blocks, trees
from morphlake.plans import catalog, evidence

SF = "/root/testdata/sf0.001"


def found(spark, name, *columns):
    return sorted(map(tuple, catalog.QUERIES[name](spark, SF).select(*columns).collect()))


@pytest.fixture(scope="module")
def cosines():
    """Both directions of all pairs of a label."""
    rows = duckdb.sql(f"select vec_id, label, embedding from '{SF}/embeddings.parquet' where label is not null").fetchall()
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    return {(a, b): round(float(unit[a] @ unit[b]), 6) for a, k, _ in rows for b, m, _ in rows if k == m and a != b}


def best_of(cosines):
    by = {}
    for (a, b), s in cosines.items():
        by.setdefault(a, []).append((-s, b))
    return {a: sorted(x) for a, x in by.items()}


def test_all_pairs_of_a_label(spark, cosines):
    assert found(spark, "blocked_cosine", "left_id", "right_id", "score") == sorted((a, b, s) for (a, b), s in cosines.items() if a < b and s >= 0.3)
    best = best_of(cosines)
    ranked = sorted((a, b, -s, 1 + sum(o < s for o, _ in x)) for a, x in best.items() for s, b in x if sum(o < s for o, _ in x) < 5)
    assert found(spark, "cosine_rank_margin", "left_id", "right_id", "score", "competition_rank") == ranked
    assert found(spark, "top3_mean_similarity", "vec_id", "best_id") == sorted((a, x[0][1]) for a, x in best.items())
    top = {a: b for a, ((s, b), *rest) in best.items() if not rest or rest[0][0] > s}
    assert found(spark, "mutual_top1", "left_id", "right_id") == sorted((a, b) for a, b in top.items() if a < b and top.get(b) == a)


def test_families_of_a_label(spark, cosines):
    labels = dict(duckdb.sql(f"select vec_id, label from '{SF}/embeddings.parquet' where label is not null").fetchall())
    at = {n: n for n in labels}
    for (a, b), s in sorted(cosines.items(), key=lambda x: (-x[1], x[0])):
        if a < b and s >= 0.2 and at[a] != at[b]:
            one, two = ([n for n in labels if at[n] == at[x]] for x in (a, b))
            if not {n % 7 for n in one} & {n % 7 for n in two}:
                at |= dict.fromkeys(one + two, min(at[a], at[b]))
    assert found(spark, "family_components", "node", "component") == sorted(at.items())


def test_blocks_change_nothing(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = v.unionByName(v.limit(20).selectExpr("vec_id + 100000 as vec_id", "embedding", "label"))  # exact copies
    rows = lambda **x: sorted(map(tuple, blocks.cosine_pairs(v, "label", **x).collect()))
    assert rows(least=0.1, size=7) == rows(least=0.1)
    rank = lambda **x: evidence.ranking.rank_with_margin(blocks.cosine_pairs(v, "label", top=5, **x), ["l"], "score", "r").where("competition_rank <= 5")
    assert sorted(map(tuple, rank(size=7).collect())) == sorted(map(tuple, rank().collect()))


def test_vectors_without_direction(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 0, None), (5, 0, [1.0, None]), (6, 0, []), (7, 0, [1.0, 0.0, 0.0]), (8, None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, blocks.cosine_pairs(v, "label", least=-1.0).collect())) == [(0, 1, 2, 1.0)]


WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")


def counts_of(name, key):
    """Words of every row's whole text, lower-cased, with how often the row has them."""
    return {k: Counter(w.lower() for w in WORD.findall(t)) for k, t in duckdb.sql(f"select {key}, text from '{SF}/{name}.parquet' where text is not null").fetchall()}


def test_every_item_is_looked_up(spark):
    docs, items = counts_of("documents", "doc_id"), counts_of("benchmark", "item_id")
    asked, by = set().union(*items.values()), {}
    for d, words in docs.items():
        for w in words.keys() & asked:
            by.setdefault(w, []).append((-(80 - min(words[w], 6) * 10), words[w], d))
    want = [(w, k, d, -r, n) for w, x in by.items() for k, (r, n, d) in enumerate(sorted(x)[:6], 1)]
    assert found(spark, "gloss_index_lookup", "word", "rn", "doc_id", "rank", "n") == sorted(want)


@pytest.mark.parametrize("name", ["weighted_overlap", "top_shared_terms"])
def test_frequent_tokens_make_pairs(spark, name):
    docs, items = counts_of("documents", "doc_id"), counts_of("benchmark", "item_id")
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if x.keys() & y.keys()}
    assert set(found(spark, name, "doc_id", "item_id")) == want


def test_reply_trees_of_all_turns(spark, tmp_path):
    rng = np.random.default_rng(5)
    turns = {c: sorted(int(t) for t in rng.choice(14, rng.integers(1, 6), replace=False)) for c in range(60)}
    roles = {(c, t): [None, "user", "assistant", "tool"][rng.integers(0, 4)] for c, x in turns.items() for t in x}
    roles |= {(60, t): "user" if t % 3 else "assistant" for t in range(30)}
    spark.createDataFrame([(c, t, r, "x") for (c, t), r in roles.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for c, t, h in catalog.QUERIES["reply_trees"](spark, str(tmp_path)).select("sentence", "dependent", "head").collect():
        got.setdefault(c, {})[t - 1] = h - 1
    assert sorted((c, t) for c, x in got.items() for t in x) == sorted(roles)
    for c, x in got.items():
        own = sorted(x)
        s = np.full((len(own) + 1, len(own) + 1), trees.NONE)
        for k, t in enumerate(own, 1):
            s[0, k] = -t
            for j, h in enumerate(own, 1):
                a, b = roles[c, t], roles[c, h]
                if h != t:
                    s[j, k] = (2 if a and b and a != b else 0) - 0.5 * abs(t - h) - (4 if h > t else 0)
        place = {-1: 0} | {t: k for k, t in enumerate(own, 1)}
        best = (trees.exact_tree if len(own) < 6 else trees.spanning_tree)(s)
        assert trees.score_of([0, *(place[x[t]] for t in own)], s) == trees.score_of(best, s)
