"""Imports every query module of this folder once."""

from __future__ import annotations


def load():
    """(queries, oracles)"""
    from provspark.llm import (  # noqa: F401
        bpe_query,
        clusters_query,
        decontaminate_query,
        jaccard_query,
        langid_query,
        merkle_query,
        mixing_query,
        near_vectors_query,
        repeats_query,
        rollup_query,
        topk_query,
        toxicity_query,
        url_query,
    )
    from provspark.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
