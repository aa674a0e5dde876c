"""Whole jobs: corpus views over star-schema tables, and named queries."""

from lexspark.plans import queries_analytics, queries_cases, queries_sources, queries_text
from lexspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries_analytics", "queries_cases", "queries_sources", "queries_text"]
