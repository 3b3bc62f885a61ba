"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sparkwake.plans import config_queries, graph_queries, nested_queries, resolve_queries, source_queries

MODULES = (graph_queries, resolve_queries, source_queries, nested_queries, config_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
