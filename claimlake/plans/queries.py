"""All queries over the driver's tables, by name, with their SQL counterparts."""

from __future__ import annotations

from claimlake.plans import driver_queries, engine_queries, nested_queries

_MODULES = (driver_queries, engine_queries, nested_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
FLAGSHIP = "similar_paths"
