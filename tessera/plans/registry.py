"""Queries of the reference's operators and their SQL equivalents."""

from __future__ import annotations

from . import operator_queries, profile_queries, record_queries, source_queries, trace_queries

_PARTS = (profile_queries, operator_queries, trace_queries, record_queries, source_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
