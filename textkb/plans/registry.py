"""All registered queries of the knowledge base and the SQL that states the same result."""

from __future__ import annotations

from . import chapter_queries, ingest_queries, relate_queries, search_queries, text_queries, view_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
