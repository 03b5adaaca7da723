"""The queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from weftwork.plans import context_queries, model_queries, structure_queries, text_queries

_PARTS = (text_queries, structure_queries, model_queries, context_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.Q.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.O.items()}
