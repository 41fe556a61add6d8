"""Queries of the millrace analytics library."""

from . import features, learning, relational, retrieval, stores
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "features", "learning", "relational", "retrieval", "stores"]
