"""Recognizers over sequences of categories: Earley's chart, and LR(0) tables with lookahead over a graph of stacks.

A grammar is a list of (left, right): a symbol that is a left side is a nonterminal, the first left side is the start.
Both take any context-free grammar, ambiguous ones and empty right sides too.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Grammar = list[tuple[str, tuple[str, ...]]]


def clause_grammar(categories: Sequence[str], finite: str, fragment: bool = False) -> Grammar:
    """A clause is any categories around a finite one; a fragment is any categories at all."""
    top = ("Units",) if fragment else ("Units", finite, "Units")
    return [("Clause", top), ("Units", ("Units", "Unit")), ("Units", ()), *[("Unit", (c,)) for c in categories]]


def nullable(grammar: Grammar) -> set[str]:
    found: set[str] = set()
    while new := {left for left, right in grammar if left not in found and found.issuperset(right)}:
        found |= new
    return found


def earley(grammar: Grammar, symbols: Sequence[str]) -> bool:
    """Whether the grammar derives the symbols. An item is (rule, dot, origin)."""
    start, empty = grammar[0][0], nullable(grammar)
    rules: dict[str, list[int]] = {}
    for k, (left, _) in enumerate(grammar):
        rules.setdefault(left, []).append(k)
    waiting: list[dict[str, list[tuple[int, int, int]]]] = []
    seeds = [(k, 0, 0) for k in rules[start]]
    for at in range(len(symbols) + 1):
        here, todo, wants = set(seeds), list(seeds), {}
        waiting.append(wants)
        seeds = []
        while todo:
            rule, dot, origin = todo.pop()
            left, right = grammar[rule]
            new = []
            if dot == len(right):
                new = [(r, d + 1, o) for r, d, o in waiting[origin].get(left, ())]
            elif right[dot] in rules:
                wants.setdefault(right[dot], []).append((rule, dot, origin))
                new = [(k, 0, at) for k in rules[right[dot]]]
                if right[dot] in empty:  # what is complete here before it is asked for
                    new.append((rule, dot + 1, origin))
            elif at < len(symbols) and right[dot] == symbols[at]:
                seeds.append((rule, dot + 1, origin))
            for item in new:
                if item not in here:
                    here.add(item)
                    todo.append(item)
    return any(grammar[r][0] == start and d == len(grammar[r][1]) and o == 0 for r, d, o in here)


class Table:
    """LR(0) states of a grammar, with reductions limited to the symbols that can follow the left side."""

    END = None

    def __init__(self, grammar: Grammar):
        self.rules = [("", (grammar[0][0],)), *grammar]
        left = {a for a, _ in grammar}
        first: dict[str, set] = {a: set() for a in left}
        follow: dict[str, set] = {a: set() for a in left}
        follow[grammar[0][0]].add(self.END)
        empty, size = nullable(grammar), -1
        while size != (size := sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for a, right in grammar:
                for x in right:
                    first[a] |= first[x] if x in left else {x}
                    if x not in empty:
                        break
                after = set(follow[a])
                for x in reversed(right):
                    if x in left:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
        states = [self._closure({(0, 0)})]
        index = {states[0]: 0}
        self.moves: list[dict] = []
        self.reduce: list[list[tuple[int, set]]] = []
        for state in states:  # grows
            onto: dict[str, set] = {}
            for rule, dot in state:
                right = self.rules[rule][1]
                if dot < len(right):
                    onto.setdefault(right[dot], set()).add((rule, dot + 1))
            moves = {}
            for x, items in onto.items():
                nxt = self._closure(items)
                if nxt not in index:
                    index[nxt] = len(states)
                    states.append(nxt)
                moves[x] = index[nxt]
            self.moves.append(moves)
            self.reduce.append([(rule, follow[self.rules[rule][0]]) for rule, dot in sorted(state) if rule and dot == len(self.rules[rule][1])])
        self.accept = self.moves[0].get(grammar[0][0])

    def _closure(self, items: set) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right):
                for k, (a, _) in enumerate(self.rules):
                    if a == right[dot] and (k, 0) not in found:
                        found.add((k, 0))
                        todo.append((k, 0))
        return frozenset(found)


def glr(table: Table, symbols: Sequence[str]) -> bool:
    """Whether any of the stacks accepts. Stacks share their nodes, (place, state); each has the nodes below it."""
    below: dict[tuple[int, int], set[tuple[int, int]]] = {(0, 0): set()}
    for at in range(len(symbols) + 1):
        ahead = symbols[at] if at < len(symbols) else Table.END
        grown = True
        while grown:  # an edge to a node that was reduced over already opens new ways through it
            grown = False
            for node in [n for n in below if n[0] == at]:
                for rule, follow in table.reduce[node[1]]:
                    if ahead not in follow:
                        continue
                    left, right = table.rules[rule]
                    bases = {node}
                    for _ in right:
                        bases = {b for n in bases for b in below[n]}
                    for base in bases:
                        top = (at, table.moves[base[1]][left])
                        if base not in below.setdefault(top, set()):
                            below[top].add(base)
                            grown = True
        if ahead is Table.END:
            return (at, table.accept) in below
        for node in [n for n in below if n[0] == at]:
            if ahead in table.moves[node[1]]:
                below.setdefault((at + 1, table.moves[node[1]][ahead]), set()).add(node)
    return False


def recognized(sequences: DataFrame, symbols: str, grammars: dict[str, Grammar]) -> DataFrame:
    """`sequences` with, for each grammar, <name>_earley and <name>_glr. Distinct sequences are parsed once each; a null one is refused."""
    names = [f"{n}_{way}" for n in grammars for way in ("earley", "glr")]

    def run(frames: Iterable[pd.DataFrame]):
        tables = {n: Table(g) for n, g in grammars.items()}
        for f in frames:
            said = [[v for n, g in grammars.items() for v in (earley(g, s), glr(tables[n], s))] for s in map(list, f["__s"])]
            yield pd.concat([f, pd.DataFrame(said, columns=names, index=f.index, dtype=bool)], axis=1)

    distinct = sequences.select(F.col(symbols).alias("__s")).where("__s is not null").distinct()
    found = distinct.mapInPandas(run, ", ".join(["__s array<string>", *[f"{n} boolean" for n in names]]))
    met = sequences.join(found, F.col(symbols) == F.col("__s"), "left").drop("__s")
    return met.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})
