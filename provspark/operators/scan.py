"""Ordered scans (running sums, ranks, carried values) that no single task has to hold.

A window ordered over a whole table, or over one hot key, runs in one task. Here the order column is cut into ranges
first: each (key, range) is scanned on its own, the range totals are scanned per key (at most one row per range) and
added back. The split points are computed once and inlined as literals, so both branches of the plan, and every retry
after a lost executor, see the same ranges.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.session import partitions

RANGE = "_range"


def split_points(df: DataFrame, order: str, parts: int | None = None) -> list[float]:
    """At most ``parts - 1`` increasing split points of a numeric column (a bounded driver-side list).

    Only finite ones: the ends of the outer ranges are infinite anyway.
    """
    parts = parts or partitions(df.sparkSession)
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    found = df.select(F.col(order).cast("double").alias(order)).approxQuantile(order, probs, 1.0 / (4 * parts))
    return sorted({p for p in found if math.isfinite(p)})


def with_range(df: DataFrame, order: str, points: Sequence[float]) -> DataFrame:
    """Add the range number; equal values always share a range."""
    if not points:
        return df.withColumn(RANGE, F.lit(0.0))
    splits = [float("-inf"), *points, float("inf")]
    position = "_order_as_double"
    bucketizer = Bucketizer(splits=splits, inputCol=position, outputCol=RANGE, handleInvalid="keep")
    return bucketizer.transform(df.withColumn(position, F.col(order).cast("double"))).drop(position)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    spec: Mapping[str, tuple[str, Column]],
    *,
    ties: Sequence[str] = (),
    descending: bool = False,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive scan along ``order`` within ``keys``.

    ``spec`` maps a new column to ``(kind, value)``; kind is ``sum``, ``max`` or ``last`` (last non-null value). For
    rows that share a value of ``order`` there are ``upto`` (running sum that includes all of them) and ``peers``
    (their sum alone); equal values always lie in one range.
    ``ties`` refines the order inside equal values of ``order``; rows must be unique under (keys, order, ties).
    """
    keys = list(keys)
    points = split_points(df, order) if points is None else points
    source = with_range(df, order, points)
    for name, (_, value) in spec.items():
        source = source.withColumn(f"_v_{name}", value)

    def direction(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    running = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(*[direction(c) for c in [order, *ties]])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(direction(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
        if keys
        else Window.orderBy(direction(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    )
    with_peers = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(direction(order))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.struct(*[F.col(c) for c in [order, *ties]])
    totals, carried, local, combined = [], [], [], {}
    for name, (kind, _) in spec.items():
        value, total = F.col(f"_v_{name}"), f"_t_{name}"
        if kind == "peers":
            local.append(F.sum(value).over(Window.partitionBy(*keys, RANGE, order)).alias(name))
        elif kind in ("sum", "upto"):
            totals.append(F.sum(value).alias(total))
            carried.append(F.sum(total).over(before).alias(f"_c_{name}"))
            local.append(F.sum(value).over(running if kind == "sum" else with_peers).alias(name))
            combined[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        elif kind == "max":
            totals.append(F.max(value).alias(total))
            carried.append(F.max(total).over(before).alias(f"_c_{name}"))
            local.append(F.max(value).over(running).alias(name))
            combined[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
        elif kind == "last":
            pick = F.min_by if descending else F.max_by
            totals.append(pick(value, F.when(value.isNotNull(), position)).alias(total))
            carried.append(F.last(total, ignorenulls=True).over(before).alias(f"_c_{name}"))
            local.append(F.last(value, ignorenulls=True).over(running).alias(name))
            combined[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
    scanned = source.select(*source.columns, *local)
    if points:
        offsets = source.groupBy(*keys, RANGE).agg(*totals).select(*keys, RANGE, *carried)
        scanned = scanned.join(offsets, [*keys, RANGE], "left").withColumns(combined)
    return scanned.select(*df.columns, *spec)


def row_index(df: DataFrame, order: str, name: str = "idx", keys: Sequence[str] = (), **kw) -> DataFrame:
    """0-based position of every row along a unique ``order`` column."""
    out = scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, **kw)
    return out.withColumn(name, F.col(name) - 1)
