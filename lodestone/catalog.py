"""Registered queries over the test tables and the SQL that each must equal."""

from __future__ import annotations

from lodestone.plans import code_queries, corpus_queries, project_queries, search_queries, source_queries

MODULES = (search_queries, corpus_queries, code_queries, project_queries, source_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
