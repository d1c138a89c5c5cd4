"""Registered queries of the library and their SQL."""

from __future__ import annotations

from mizan.plans import evaluation_queries, page_queries, search_queries, series_queries, store_queries, text_queries, upkeep_queries  # noqa: F401
from mizan.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark, sf_dir):
    """The flagship: hybrid search over the smallest tables."""
    return search_queries.hybrid_search(spark, sf_dir)
