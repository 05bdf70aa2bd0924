"""Queries over the given tables."""

from __future__ import annotations


def load_queries():
    """Import every query module once and return (queries, oracles)."""
    from provspark.plans import (  # noqa: F401
        analysis_queries,
        curation_queries,
        dedup_queries,
        metric_queries,
        model_queries,
    )
    from provspark.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
