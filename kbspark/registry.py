"""Every query of the library with the SQL that checks it."""

from __future__ import annotations

from kbspark.plans import eval_queries, model_queries, page_queries, source_queries, story_queries, vector_queries

MODULES: list = [source_queries, page_queries, vector_queries, story_queries, eval_queries, model_queries]


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.SQL
    return found
