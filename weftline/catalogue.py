"""All queries by survey key, with their SQL oracles."""

from __future__ import annotations

from weftline.plans import documents, files, functions, graphs, history, status, streams, tables
from weftline.plans.registry import Query

_MODULES = (tables, documents, history, status, graphs, functions, files, streams)


def queries() -> dict[str, Query]:
    return {key: query for module in _MODULES for key, query in module.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _MODULES for key, sql in module.plans.oracles.items()}
