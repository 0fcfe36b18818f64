"""All queries of the core and their oracles."""

from __future__ import annotations

from factloom.plans import core_queries, nested_queries, question_queries

QUERIES = {**core_queries.QUERIES, **question_queries.QUERIES, **nested_queries.QUERIES}
ORACLES = {**core_queries.ORACLES, **question_queries.ORACLES, **nested_queries.ORACLES}
