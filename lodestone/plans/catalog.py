"""Every query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from lodestone.plans import code_queries, graph_queries, search_queries, security_queries

ALL = {**search_queries.QUERIES, **graph_queries.QUERIES, **security_queries.QUERIES, **code_queries.QUERIES}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
