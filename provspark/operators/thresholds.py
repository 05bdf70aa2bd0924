"""Thresholds for a wanted false-positive rate.

A score exceeds a threshold only when it is strictly greater. Columns: detector, grp, score; a score histogram may stand
in for the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.histogram import TIMES, rows_of
from provspark.operators.radix import TOLERANCE, select_mean_tail, select_ranks
from provspark.operators.ranks import exact_quantiles, value_counts
from provspark.operators.scan import scan
from provspark.session import settle


def threshold_quantile(negatives: DataFrame, fpr: Sequence[float], keys: Sequence[str] = ("detector",)) -> DataFrame:
    """The linear-interpolated (1 - fpr) quantile of the pooled negatives; one row per key and target."""
    wide = exact_quantiles(negatives, keys, "score", [1.0 - f for f in fpr], prefix="t")
    return _long(settle(wide), keys, fpr)


def _long(wide: DataFrame, keys: Sequence[str], fpr: Sequence[float]) -> DataFrame:
    pairs = [
        F.struct(F.lit(float(f)).alias("target"), F.col(f"t{i}").alias("threshold")) for i, f in enumerate(fpr)
    ]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("r")).select(*keys, "r.*")


def threshold_group_mean(negatives: DataFrame, fpr: Sequence[float], points: Sequence[float] | None = None) -> DataFrame:
    """Smallest observed score whose exceedance, averaged over groups with equal weight, is at most the target.

    Rows go through one radix select for all targets. A histogram is scanned once instead; ``points``: split points of
    its scores, where the caller has them.
    """
    if TIMES not in negatives.columns:
        return settle(select_mean_tail(negatives, ["detector"], "grp", "score", fpr))
    ordered = scan(_group_weights(negatives), ["detector"], "score", {"from_top": ("sum", F.col("w"))}, descending=True, points=points)
    above = F.col("from_top") - F.col("w")
    wide = ordered.groupBy("detector").agg(
        *[F.min(F.when(above <= f + TOLERANCE, F.col("score"))).alias(f"t{i}") for i, f in enumerate(fpr)]
    )
    return _long(settle(wide), ["detector"], fpr)


def _group_weights(negatives: DataFrame) -> DataFrame:
    """Every distinct score with its weight ``w``, groups weighing the same."""
    sizes = negatives.groupBy("detector", "grp").agg(rows_of(negatives).alias("_n"))
    groups = sizes.groupBy("detector").agg(F.count(F.lit(1)).alias("_g"))
    weights = sizes.join(groups, "detector").select(
        "detector", "grp", (1.0 / (F.col("_g") * F.col("_n"))).alias("share")
    )
    return (
        value_counts(negatives, ["detector", "grp"], "score")
        .join(weights, ["detector", "grp"])
        .groupBy("detector", "score")
        .agg(F.sum(F.col("share") * F.col("n")).alias("w"))
    )


def cumulative_weight(negatives: DataFrame) -> DataFrame:
    """For every distinct score the equal-group weight strictly above it."""
    ordered = scan(_group_weights(negatives), ["detector"], "score", {"from_top": ("sum", F.col("w"))}, descending=True)
    return ordered.select("detector", "score", "w", (F.col("from_top") - F.col("w")).alias("above"))


def kth_largest(df: DataFrame, keys: Sequence[str], value: str, count_of: str) -> DataFrame:
    """The k-th largest value per key, k given per key as a SQL expression over the row count ``total``; nulls are no
    rows, NaN is the largest value. No row where k is beyond ``total``."""
    keys = list(keys)
    found = select_ranks(df, keys, value, F.array(F.col("total") - F.expr(count_of)), count="total")
    return found.select(*keys, "total", (F.col("total") - F.col("rank")).alias("k"), F.col("value").alias("kth"))


def threshold_kth(negatives: DataFrame, fpr: float, keys: Sequence[str] = ("detector",)) -> DataFrame:
    """The max(1, round-half-even(fpr * n))-th largest negative; use it strictly (``score > kth``) or not (``>=``)."""
    found = kth_largest(negatives, keys, "score", f"greatest(1, cast(bround({fpr!r}D * total, 0) as bigint))")
    return settle(found.select(*keys, F.col("total").alias("n"), "k", F.col("kth").alias("threshold")))


def roc_bracket(
    negatives: DataFrame, fpr: Sequence[float], keys: Sequence[str] = ("detector",), points: Sequence[float] | None = None
) -> DataFrame:
    """For each target the negative score ``edge`` where the ROC curve crosses it, with the rates beside it.

    Going down from the top, ``edge`` is the first score at which the false-positive rate exceeds the target;
    ``fpr_above`` and ``fpr_at`` are the rates strictly above it and including it. Only negatives move the curve
    sideways, so this is all that interpolation needs, whatever the number of positive groups. Rows go through one radix
    select for all targets, a histogram through one scan.
    """
    keys = list(keys)
    if TIMES not in negatives.columns:
        first_over = [F.col("total") - F.floor(F.lit(float(f)) * F.col("total")) - 1 for f in fpr]
        found = select_ranks(negatives, keys, "score", F.array(*first_over), count="total")
        target = F.element_at(F.array(*[F.lit(float(f)) for f in fpr]), F.col("i") + 1)
        over = F.col("total") - F.col("below")
        return settle(
            found.select(
                *keys,
                target.alias("target"),
                F.col("value").alias("edge"),
                ((over - F.col("peers")) / F.col("total")).alias("fpr_above"),
                (over / F.col("total")).alias("fpr_at"),
            )
        )
    known = negatives.where(F.col("score").isNotNull())
    totals = settle(known.groupBy(*keys).agg(rows_of(negatives).alias("total")))
    counted = value_counts(known, keys, "score")
    ordered = scan(counted, keys, "score", {"from_top": ("sum", F.col("n"))}, descending=True, points=points)
    targets = F.explode(F.array(*[F.lit(float(f)) for f in fpr]))
    return settle(
        ordered.join(totals, keys)
        .select(*keys, "score", "n", "from_top", "total", targets.alias("target"))
        .where(F.col("from_top") >= F.floor(F.col("target") * F.col("total")) + 1)
        .groupBy(*keys, "target", "total")
        .agg(F.max(F.struct("score", "from_top", "n")).alias("e"))
        .select(
            *keys,
            "target",
            F.col("e.score").alias("edge"),
            ((F.col("e.from_top") - F.col("e.n")) / F.col("total")).alias("fpr_above"),
            (F.col("e.from_top") / F.col("total")).alias("fpr_at"),
        )
    )
