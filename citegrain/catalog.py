"""Every query by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from citegrain.plans import graph_queries, scalar_queries, seed_queries, source_queries, statistics_queries, suite_queries, venue_queries, window_queries

_MODULES = (source_queries, scalar_queries, seed_queries, graph_queries, venue_queries, window_queries, statistics_queries, suite_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.registry.queries.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.registry.sql.items()}
