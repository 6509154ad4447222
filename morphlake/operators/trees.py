"""Dependency trees of a sentence: exact, projective and maximum spanning decoders as grouped maps."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = -np.inf


def _chain(heads: list[int]) -> bool:
    """Whether every node reaches the root (0) over its heads."""
    for node in range(1, len(heads)):
        seen, at = set(), node
        while at:
            if at in seen:
                return False
            seen.add(at)
            at = heads[at]
    return True


def score_of(heads: list[int], scores: np.ndarray) -> float:
    return float(sum(scores[h, d] for d, h in enumerate(heads) if d))


def exact_tree(scores: np.ndarray) -> list[int] | None:
    """The best tree by trying all: scores[h, d] for head h and dependent d, node 0 the root with exactly
    one dependent. Ties go to the first heads in order."""
    n = len(scores)
    best, out = NONE, None
    for heads in product(*[[h for h in range(n) if h != d and scores[h, d] > NONE] for d in range(1, n)]):
        tree = [0, *heads]
        if heads.count(0) == 1 and (s := score_of(tree, scores)) > best and _chain(tree):
            best, out = s, tree
    return out


def projective_tree(scores: np.ndarray) -> list[int] | None:
    """The best tree without crossing arcs: the cubic dynamic program over spans, with one root dependent."""
    n = len(scores)
    best, out = NONE, None
    inner = scores[1:, 1:]
    m = n - 1
    # best[i][j][side][complete]: spans headed at the left (1) or right (0) end
    table = np.full((m, m, 2, 2), NONE)
    back: dict = {}
    for i in range(m):
        table[i, i] = 0.0
    for size in range(1, m):
        for i in range(m - size):
            j = i + size
            spots = [(table[i, k, 1, 1] + table[k + 1, j, 0, 1], k) for k in range(i, j)]
            top, k = max(spots, key=lambda x: (x[0], -x[1]))
            for side, s in ((0, inner[j, i]), (1, inner[i, j])):
                table[i, j, side, 0] = top + s
                back[i, j, side, 0] = k
            left = [(table[i, k, 0, 1] + table[k, j, 0, 0], k) for k in range(i, j)]
            right = [(table[i, k, 1, 0] + table[k, j, 1, 1], k) for k in range(i + 1, j + 1)]
            for side, found in ((0, left), (1, right)):
                table[i, j, side, 1], back[i, j, side, 1] = max(found, key=lambda x: (x[0], -x[1]))
    for root in range(m):
        s = table[0, root, 0, 1] + table[root, m - 1, 1, 1] + scores[0, root + 1]
        if s > best:
            heads = [0] * n
            _unfold(0, root, 0, 1, back, heads)
            _unfold(root, m - 1, 1, 1, back, heads)
            heads[root + 1] = 0
            best, out = s, heads
    return out


def _unfold(i: int, j: int, side: int, complete: int, back: dict, heads: list[int]) -> None:
    todo = [(i, j, side, complete)]
    while todo:
        i, j, side, complete = todo.pop()
        if i == j:
            continue
        k = back[i, j, side, complete]
        if not complete:
            dep, head = (i, j) if side == 0 else (j, i)
            heads[dep + 1] = head + 1
            todo += [(i, k, 1, 1), (k + 1, j, 0, 1)]
        elif side == 0:
            todo += [(i, k, 0, 1), (k, j, 0, 0)]
        else:
            todo += [(i, k, 1, 0), (k, j, 1, 1)]


def spanning_tree(scores: np.ndarray) -> list[int] | None:
    """The best tree, crossing arcs allowed: contraction of cycles, once for each choice of the root's
    one dependent."""
    n = len(scores)
    best, out = NONE, None
    for root in range(1, n):
        if scores[0, root] == NONE:
            continue
        s = scores.copy()
        s[0, [d for d in range(1, n) if d != root]] = NONE
        heads = _contract(s, 0)
        if heads and (value := score_of(heads, scores)) > best:
            best, out = value, heads
    return out


def _contract(scores: np.ndarray, root: int) -> list[int] | None:
    n = len(scores)
    s = scores.copy()
    np.fill_diagonal(s, NONE)
    heads = [0 if d == root else int(s[:, d].argmax()) for d in range(n)]
    if any(d != root and s[heads[d], d] == NONE for d in range(n)):
        return None
    cycle = next((c for d in range(n) if (c := _cycle(heads, d, root))), None)
    if not cycle:
        return heads
    inside, rest = set(cycle), [d for d in range(n) if d not in cycle]
    total = sum(s[heads[c], c] for c in cycle)
    index = {d: k for k, d in enumerate(rest)}
    m = len(rest)
    small = np.full((m + 1, m + 1), NONE)
    enter, leave = {}, {}
    for a in rest:
        for b in rest:
            small[index[a], index[b]] = s[a, b]
        gain = [(s[a, c] - s[heads[c], c] + total, -c) for c in cycle]
        top, c = max(gain)
        small[index[a], m], enter[a] = top, -c
        out, c = max((s[c, a], -c) for c in cycle)
        small[m, index[a]], leave[a] = out, -c
    found = _contract(small, index[root])
    if not found:
        return None
    back = {k: d for d, k in index.items()}
    result = list(heads)
    for a in rest:
        if a != root:
            h = found[index[a]]
            result[a] = leave[a] if h == m else back[h]
    into = back[found[m]]
    result[enter[into]] = into
    assert inside
    return result


def _cycle(heads: list[int], start: int, root: int) -> list[int]:
    seen, at = [], start
    while at != root and at not in seen:
        seen.append(at)
        at = heads[at]
    return [] if at == root else seen[seen.index(at) :]


DECODERS = {"exact": exact_tree, "projective": projective_tree, "spanning": spanning_tree}


def decode(arcs: DataFrame, decoder: str = "spanning") -> DataFrame:
    """arcs (sentence, head, dependent, score; head 0 is the root, nodes count from 1) to the best tree:
    (sentence, dependent, head). Sentences without a tree have no row. A group is one sentence."""
    best = DECODERS[decoder]

    def one(t: pa.Table) -> pa.Table:
        head, dep, score = (t.column(c).to_numpy() for c in ("head", "dependent", "score"))
        n = int(max(head.max(), dep.max())) + 1
        scores = np.full((n, n), NONE)
        np.maximum.at(scores, (head, dep), score)  # the best of equal arcs
        tree = best(scores) or []
        return pa.table({"sentence": pa.array([t.column("sentence")[0].as_py()] * max(0, len(tree) - 1), t.column("sentence").type), "dependent": pa.array(range(1, len(tree)), pa.int32()), "head": pa.array(tree[1:], pa.int32())})

    kind = arcs.schema["sentence"].dataType.simpleString()
    return arcs.groupBy("sentence").applyInArrow(one, f"sentence {kind}, dependent int, head int")
