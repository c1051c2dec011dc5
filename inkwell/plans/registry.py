"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from inkwell.plans import eval_queries, record_queries, source_queries, style_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **style_queries.QUERIES, **record_queries.QUERIES, **eval_queries.QUERIES, **source_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **style_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **eval_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}
