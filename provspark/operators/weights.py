"""Training weights: balanced by class and source, covariates equalised, hard negatives raised; mean one.

Counts are small tables (one row per class and source), settled and joined back without shuffling the rows; the mean
that weights are divided by follows from those tables, without another pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.ranks import exact_quantiles
from provspark.session import settle


def _mean_one(df: DataFrame, weight: str) -> DataFrame:
    (mean,) = df.agg(F.avg(weight)).first()
    return df.withColumn(weight, F.col(weight) / F.lit(mean))


def _shared(df: DataFrame, shares: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Rows with the weight of their group; the mean over rows comes from the groups and their sizes."""
    fixed = settle(shares)
    mean = fixed.agg(F.sum(F.col(weight) * F.col("_rows")) / F.sum("_rows")).first()[0]
    return df.join(fixed.drop("_rows"), list(keys)).withColumn(weight, F.col(weight) / F.lit(mean))


def balanced_weights(df: DataFrame, mode: str, label: str = "label", source: str = "source", weight: str = "w") -> DataFrame:
    """``class``: humans weigh machines / humans. ``source``: every source the same total. ``both``: half per class,
    then equal shares for the sources of the class."""
    if mode == "class":
        n = df.agg(
            F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count("*").alias("n")
        ).first()
        ratio = n["n1"] / max(n["n0"], 1)
        mean = (n["n0"] * ratio + n["n"] - n["n0"]) / max(n["n"], 1)
        return df.withColumn(weight, F.when(F.col(label) == 0, F.lit(ratio / mean)).otherwise(F.lit(1.0 / mean)))
    if mode == "source":
        sizes = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("_rows"))
        return _shared(df, sizes.withColumn(weight, 1.0 / F.col("_rows")), [source], weight)
    if mode == "both":
        cells = df.where(F.col(label).isNotNull() & F.col(source).isNotNull()).groupBy(label, source)
        cells = cells.agg(F.count("*").alias("_rows"))
        classes = cells.groupBy(label).agg(F.count("*").alias("_sources"))
        shares = cells.join(classes, label).withColumn(weight, 0.5 / F.col("_sources") / F.col("_rows"))
        return _shared(df, shares.select(label, source, "_rows", weight), [label, source], weight)
    raise ValueError(f"unknown mode {mode!r}")


def merge_weight_groups(df: DataFrame, rules: Mapping[str, Sequence[str]], source: str = "source") -> DataFrame:
    """Several sources count as one for weighting."""
    merged = F.col(source)
    for name, members in rules.items():
        merged = F.when(F.col(source).isin(*members), F.lit(name)).otherwise(merged)
    return df.withColumn("weight_group", merged)


def equalise_covariate(
    df: DataFrame, covariate: str, label: str = "label", weight: str = "w", clip: tuple[float, float] = (0.1, 10.0)
) -> DataFrame:
    """Shift weights so that both classes have the mean of their covariate distributions; -1 = unknown, untouched."""
    known = F.col(covariate) >= 0
    every = settle(
        df.groupBy(label, F.when(known, F.col(covariate)).alias(covariate)).agg(
            F.sum(weight).alias("_m"), F.count(weight).alias("_rows")
        )
    )
    mass = every.where(F.col(covariate).isNotNull()).drop("_rows")
    per_class = mass.groupBy(label).agg(F.sum("_m").alias("_all"))
    shares = mass.join(per_class, label).withColumn("_p", F.col("_m") / F.col("_all"))
    target = shares.groupBy(covariate).agg((F.sum("_p") / 2.0).alias("_target"))
    factors = shares.join(target, covariate).select(
        label, covariate, F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), F.col("_target") / F.col("_p"))).alias("_f")
    )
    fixed = settle(factors)
    moved = every.join(fixed, [label, covariate], "left").agg(
        F.sum(F.col("_m") * F.coalesce(F.col("_f"), F.lit(1.0))) / F.sum("_rows")
    )
    mean = moved.first()[0]
    factor = F.coalesce(F.col("_f"), F.lit(1.0)) / F.lit(mean)
    return df.join(fixed, [label, covariate], "left").withColumn(weight, F.col(weight) * factor).drop("_f")


def hard_negative_weight(
    df: DataFrame, score: str, share: float, factor: float, label: str = "label", weight: str = "w"
) -> DataFrame:
    """The negatives an existing head scores highest weigh ``factor`` times as much."""
    (cut,) = exact_quantiles(df.where(F.col(label) == 0), [], score, [1.0 - share]).select("q0").first()
    hard = (F.col(label) == 0) & (F.col(score) >= F.lit(cut))
    return _mean_one(df.withColumn(weight, F.when(hard, F.col(weight) * factor).otherwise(F.col(weight))), weight)
