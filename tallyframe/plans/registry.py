"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from . import file_queries, history_queries, reading_queries, register_queries, scoring_queries, text_queries

_ALL = scoring_queries.QUERIES | history_queries.QUERIES | reading_queries.QUERIES | text_queries.QUERIES | register_queries.QUERIES | file_queries.QUERIES
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
