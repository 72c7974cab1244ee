"""Queries that put the operators to work on tables."""

from __future__ import annotations


def all_queries():
    """(queries by name, SQL by name) of every module of this package."""
    from gristmill import registry
    from gristmill.plans import document_queries, market_queries, people_queries, posting_queries, run_queries, source_queries, stream_queries  # noqa: F401

    return registry.QUERIES, registry.SQL
