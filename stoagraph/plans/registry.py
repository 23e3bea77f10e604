"""All named queries of the core, with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = ["orphan_queries", "extraction_queries", "graph_queries", "vector_queries", "search_queries", "answer_queries", "page_queries", "export_queries", "relational_queries"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"stoagraph.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"stoagraph.plans.{m}").SQL.items()}
