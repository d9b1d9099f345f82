"""Registered queries over the given tables, each with its oracle where SQL can say it."""

from . import batch_queries, graph_queries, source_queries, table_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "batch_queries", "graph_queries", "source_queries", "table_queries", "text_queries"]
