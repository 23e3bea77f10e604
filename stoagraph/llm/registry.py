"""The queries of this package and their SQL, in one module per problem."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_names", "q_boilerplate", "q_terms", "q_format_duplicates", "q_chunks", "q_lookalikes", "q_leakage", "q_packing"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"stoagraph.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"stoagraph.llm.{m}").SQL.items()}
