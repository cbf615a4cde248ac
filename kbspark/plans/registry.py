"""All driver queries of the library's own operators, and their SQL."""

from __future__ import annotations

from kbspark.plans import queries_cases, queries_hierarchy, queries_index, queries_jobs, queries_search, queries_store, queries_structures, queries_tables, queries_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_cases, queries_text, queries_search, queries_hierarchy, queries_store, queries_index, queries_jobs, queries_structures, queries_tables):
    QUERIES |= _module.Q.functions
    ORACLE_SQL |= _module.Q.sql
