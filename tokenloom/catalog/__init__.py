"""Registered queries and the SQL each is checked against."""

from tokenloom.catalog import (  # noqa: F401
    context_queries,
    stream_queries,
    text_queries,
    tool_queries,
    usage_queries,
)
from tokenloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
