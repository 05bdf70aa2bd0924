"""Exact ranks and quantiles, built on partial aggregation, range-split scans and radix select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.histogram import rows_of
from provspark.operators.radix import select_ranks
from provspark.operators.scan import scan


def value_counts(df: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Distinct values with multiplicity; combines map-side, so ties and copies never travel."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows_of(df).alias(n))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank") -> DataFrame:
    """Ascending rank of each distinct value within ``keys``; ties share the mean of their positions."""
    counted = scan(value_counts(df, keys, value), keys, value, {"upto": ("sum", F.col("n"))})
    return counted.withColumn(rank, F.col("upto") - (F.col("n") - 1) / 2.0)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], prefix: str = "q"
) -> DataFrame:
    """Linear-interpolated quantiles per key, columns ``q0, q1, ...`` plus the row count ``n``.

    Both neighbours of every wanted position come from one radix select. Nulls and NaN take no part; without keys an
    empty table gives one row with ``n`` = 0 and nulls.
    """
    keys = list(keys)
    rows = df.where(~F.isnan(F.col(value).cast("double")))
    positions = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    found = select_ranks(rows, keys, value, F.array(*[f(at) for at in positions for f in (F.floor, F.ceil)]))
    picked = found.groupBy(*keys, *(["n"] if keys else [])).agg(
        *([] if keys else [F.coalesce(F.max("n"), F.lit(0)).alias("n")]),
        *[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_v{i}") for i in range(2 * len(probs))],
    )
    low, high = ([F.col(f"_v{2 * i + side}") for i in range(len(probs))] for side in (0, 1))
    between = [F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at))) for a, b, at in zip(low, high, positions)]
    return picked.select(*keys, "n", *[q.alias(f"{prefix}{i}") for i, q in enumerate(between)])
