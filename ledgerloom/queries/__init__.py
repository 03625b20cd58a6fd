"""The registered queries of the core: name -> (query, SQL or None)."""

from __future__ import annotations

from ledgerloom.queries import chain_queries, more_queries, quality_queries, references, signal_queries, text_queries

MODULES = (references, signal_queries, text_queries, quality_queries, chain_queries, more_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
