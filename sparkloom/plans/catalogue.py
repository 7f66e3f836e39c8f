"""All queries of the engine with their SQL oracles."""

from __future__ import annotations

from . import decisions, files, gates, merging, metrics, naming, relational, review, scalar, search, signals, similarity, stateful, streams

MODULES = (relational, metrics, scalar, similarity, streams, decisions, merging, naming, review, signals, search, stateful, gates, files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
