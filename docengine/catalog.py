"""All queries of the core by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from docengine.queries import evaluation_queries, pipeline_queries, retrieval_queries, text_queries
from docengine.queries.registry import Query

_MODULES = (text_queries, retrieval_queries, evaluation_queries, pipeline_queries)
FLAGSHIP = "e14_strategy_report"


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.query.sql.items()}
