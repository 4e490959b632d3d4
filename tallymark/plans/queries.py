"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import canonical_queries, file_queries, injection_queries, record_queries, review_queries, structure_queries

QUERIES = structure_queries.QUERIES | review_queries.QUERIES | record_queries.QUERIES | file_queries.QUERIES | injection_queries.QUERIES | canonical_queries.QUERIES
SQL = structure_queries.SQL | review_queries.SQL | record_queries.SQL | file_queries.SQL | injection_queries.SQL | canonical_queries.SQL
