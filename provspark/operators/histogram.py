"""One aggregation that all reports over a score table read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators.scan import split_points
from provspark.session import cut_lineage

TIMES = "times"


def score_histogram(scores: DataFrame, keys: Sequence[str] = ("detector", "kind", "grp"), score: str = "score") -> DataFrame:
    """Distinct scores per key and how often each occurs, as ``times``; null scores are counted too.

    It is checkpointed, so a report scans its table once, whatever it computes, and tied scores are one row. Thresholds,
    rates, AUC and ROC take it in place of the rows.
    """
    return cut_lineage(scores.groupBy(*keys, score).agg(F.count("*").alias(TIMES)))


def shared_points(*tables: DataFrame) -> list[float] | None:
    """Split points of the scores of parts of one histogram, found once for all scans of a report; None for rows, whose
    scans find their own behind what they cut off."""
    if any(TIMES not in t.columns for t in tables):
        return None
    scores = [t.select("score") for t in tables]
    for other in scores[1:]:
        scores[0] = scores[0].unionByName(other)
    return split_points(scores[0], "score")


def times(df: DataFrame) -> Column:
    """How many rows a row stands for."""
    return F.col(TIMES) if TIMES in df.columns else F.lit(1).cast("bigint")


def rows_of(df: DataFrame) -> Column:
    return F.sum(times(df))


def mean_of(value: Column, df: DataFrame) -> Column:
    """Mean over the rows that ``df`` stands for; nulls are left out."""
    weight = times(df)
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))
