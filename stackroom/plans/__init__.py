"""Queries of the engine over the driver's tables, by the ids of the operator inventory."""

from . import document_queries, index_queries, job_queries, more_queries, rule_queries, search_queries, stream_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "document_queries", "index_queries", "job_queries", "more_queries", "rule_queries", "search_queries", "stream_queries", "text_queries"]
