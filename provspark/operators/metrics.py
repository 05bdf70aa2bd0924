"""Detector metrics per group: exceedance, AUC, TPR at a false-positive rate, macro means.

Columns: detector, grp, kind, score. Kinds: ``m_val`` and ``m_test`` are human groups, ``k_gen`` and ``k_kanal`` machine
groups by generator and by channel. A score histogram may stand in for the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators.histogram import mean_of, rows_of, times
from provspark.operators.ranks import average_ranks
from provspark.operators.scan import scan
from provspark.operators.thresholds import roc_bracket
from provspark.session import settle

MACRO = {"k_gen": "mixed generators", "k_kanal": "mixed channels"}


def exceeds(score: str = "score", threshold: str = "threshold") -> Column:
    return (F.col(score) > F.col(threshold)).cast("double")


def exceed_rate(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str], on: Sequence[str] = ("detector",)):
    """Share of rows strictly above the threshold, with n, per ``keys``."""
    return scores.join(thresholds, list(on)).groupBy(*keys).agg(
        mean_of(exceeds(), scores).alias("rate"), rows_of(scores).alias("n")
    )


def auc_by_group(
    negatives: DataFrame, positives: DataFrame, keys: Sequence[str] = ("detector",), groups: Sequence[str] = ("grp",),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Mann-Whitney AUC of each positive group against the pooled negatives, ties counted half.

    Negatives and positives are counted per distinct score in one aggregation and scanned together once; every positive
    group reads how many negatives lie below and beside each of its scores. Work does not grow with groups x negatives.
    """
    keys, groups = list(keys), list(groups)
    zero = F.lit(0).cast("bigint")
    types = dict(positives.select(*groups).dtypes)
    no_group = [F.lit(None).cast(types[g]).alias(g) for g in groups]
    rows = negatives.select(*keys, *no_group, "score", times(negatives).alias("_neg"), zero.alias("_pos")).unionByName(
        positives.select(*keys, *groups, "score", zero.alias("_neg"), times(positives).alias("_pos"))
    )
    counted = (
        rows.where(F.col("score").isNotNull())
        .groupBy(*keys, *groups, "score")
        .agg(F.sum("_neg").alias("_neg"), F.sum("_pos").alias("_pos"))
    )
    placed = scan(
        counted, keys, "score", {"_upto": ("upto", F.col("_neg")), "_beside": ("peers", F.col("_neg"))}, points=points
    ).where(F.col("_pos") > 0)
    scored = negatives.where(F.col("score").isNotNull())
    total = scored.groupBy(*keys).agg(rows_of(negatives).alias("n_neg"))
    wins = F.col("_pos") * (F.col("_upto") - F.col("_beside") / 2.0)
    joined = placed.groupBy(*keys, *groups).agg(F.sum(wins).alias("_u"), F.sum("_pos").alias("n_pos"))
    joined = joined.join(total, keys) if keys else joined.withColumn("n_neg", F.lit(total.first()["n_neg"]))
    return joined.select(
        *keys, *groups, (F.col("_u") / (F.col("n_neg") * F.col("n_pos"))).alias("auc"), "n_neg", "n_pos"
    )


def auc_two_sided(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """AUC per key when negatives and positives share the key (label 0 / 1), ties averaged."""
    keys = list(keys)
    both = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 0).cast("bigint") * times(df)).alias("_neg"),
        F.sum((F.col(label) == 1).cast("bigint") * times(df)).alias("_pos"),
    )
    placed = scan(both, keys, "_s", {"_upto": ("sum", F.col("_neg"))})
    return placed.groupBy(*keys).agg(
        (
            F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2.0)) / (F.sum("_neg") * F.sum("_pos"))
        ).alias("auc"),
        F.sum("_neg").alias("n_neg"),
        F.sum("_pos").alias("n_pos"),
    )


def tpr_at_fpr(
    negatives: DataFrame,
    positives: DataFrame,
    fpr: Sequence[float],
    keys: Sequence[str] = ("detector",),
    groups: Sequence[str] = ("grp",),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Interpolated TPR of each positive group at the wanted false-positive rates.

    Ties of negatives and positives at the same score share the step, so a detector whose best score is reached by
    many negatives gets a fraction instead of zero; on a vertical stretch the upper end counts.
    """
    bracket = roc_bracket(negatives, fpr, keys, points)
    step = (F.col("target") - F.col("fpr_above")) / (F.col("fpr_at") - F.col("fpr_above"))
    above = mean_of((F.col("score") > F.col("edge")).cast("double"), positives)
    at = mean_of((F.col("score") >= F.col("edge")).cast("double"), positives)
    return (
        positives.join(bracket, list(keys))
        .groupBy(*keys, *groups, "target", "fpr_above", "fpr_at")
        .agg(above.alias("_above"), at.alias("_at"))
        .select(*keys, *groups, "target", (F.col("_above") + step * (F.col("_at") - F.col("_above"))).alias("tpr"))
    )


def macro_mean(metrics: DataFrame, value: str, kinds: Sequence[str], keys: Sequence[str] = ("detector",)) -> DataFrame:
    """Mean of group metrics, every group weighing one: per kind and over all the given kinds."""
    chosen = metrics.where(F.col("kind").isin(*kinds))
    name = F.lit("mixed all")
    for kind, label in MACRO.items():
        name = F.when(F.col("_k") == kind, F.lit(label)).otherwise(name)
    return (
        chosen.withColumn("_k", F.explode(F.array(F.col("kind"), F.lit("*"))))
        .groupBy(*keys, "_k")
        .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_groups"))
        .select(*keys, name.alias("grp"), value, "n_groups")
    )


def rank_fusion(scores: DataFrame) -> DataFrame:
    """Sum over detectors of (average rank / rows): one fused score per item."""
    ranks = average_ranks(scores, ["detector"], "score")
    sizes = settle(scores.groupBy("detector").agg(F.count("score").alias("_size")))
    return (
        scores.join(ranks.select("detector", "score", "avg_rank"), ["detector", "score"])
        .join(sizes, "detector")
        .groupBy("item_id")
        .agg(F.sum(F.col("avg_rank") / F.col("_size")).alias("fused"))
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties."""
    rx = average_ranks(df, [], x, "rx").select(x, "rx")
    ry = average_ranks(df, [], y, "ry").select(y, "ry")
    return df.select(x, y).join(rx, x).join(ry, y).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
