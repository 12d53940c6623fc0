"""Queries over the driver's tables, and their SQL."""

from . import catalogue_queries, feed_queries, more_queries, ops_queries, text_queries

_PARTS = (catalogue_queries, ops_queries, text_queries, more_queries, feed_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
