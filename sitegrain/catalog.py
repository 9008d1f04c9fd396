"""Registered queries: name -> callable(spark, sf_dir) and name -> oracle SQL."""

from __future__ import annotations

from .plans import evidence_queries, failure_queries, page_queries
from .plans.queries import ORACLES, QUERIES

FLAGSHIP = "site_contacts"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "evidence_queries", "failure_queries", "page_queries"]
