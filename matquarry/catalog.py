"""All registered queries of the library."""

from __future__ import annotations

from .plans import q_articles, q_evidence, q_more, q_science  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
