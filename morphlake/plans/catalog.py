"""All queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import choices, corpus, engine, evidence, lookup, models, parsing, readings, relational, review

MODULES = (corpus, lookup, relational, evidence, models, engine, readings, review, parsing, choices)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
