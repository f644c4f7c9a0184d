"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import decision_queries, graph_queries, ledger_queries, record_queries, source_queries, text_queries

MODULES = (graph_queries, text_queries, decision_queries, ledger_queries, source_queries, record_queries)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.REG.sql.items()}
