"""All registered queries of the engine, by name, and their SQL."""

from __future__ import annotations

from quernstone.plans import file_queries, graph_queries, log_queries, memory_queries, quality_queries, registry_queries, search_queries, semantic_queries, stack_queries, streaming_queries, text_queries, vector_queries  # noqa: F401
from quernstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
