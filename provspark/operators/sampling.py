"""Quotas, caps, targets, samples and holdouts that stay whole under hot keys.

"The first n of a group" never sorts a whole group in one task: it is cut in two stages, and in each Spark cuts to n rows
before the shuffle. Where rejected rows must stay (they carry a
reason), only the n-th position of each group is computed and compared with every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions.hashing import hash60
from provspark.operators.scan import row_index, scan

#: Parts that a group is dealt to before its first rows are put in order.
PARTS = 32


def first_n(
    df: DataFrame, keys: Sequence[str], order: str, n: int, tie: str | None = None, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group along a numeric ``order``; ``rank`` names a column for their 1-based place.

    A group is cut to its first n rows per map task and part, then per part, then as a whole: the task that puts a hot
    group in order gets at most ``PARTS`` times n rows, however many there are.
    """
    place = rank or "_rn"
    by = [F.col(order)] + ([F.col(tie)] if tie else [])
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(order, *([tie] if tie else [])), F.lit(PARTS)))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by))
    fewer = dealt.withColumn(place, within).where(F.col(place) <= n).drop(place, "_part")
    kept = fewer.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def quota_cutoff(df: DataFrame, keys: Sequence[str], arrival: str, n: int, prior: DataFrame | None = None) -> DataFrame:
    """Per group that reaches its quota: the arrival of the row that takes the last free slot (null: none was free)."""
    keys = list(keys)
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    ranked = first_n(known.select(*keys, arrival), keys, arrival, n, rank="_rn")
    if prior is None:
        return ranked.where(F.col("_rn") == n).select(*keys, F.col(arrival).alias("_last"))
    counted = prior.select(*keys, F.col("prior").alias("_prior"))
    left = F.lit(n) - F.coalesce(F.col("_prior"), F.lit(0))
    within = ranked.join(counted, keys, "left").where(F.col("_rn") == left).select(*keys, F.col(arrival).alias("_last"))
    used_up = counted.where(F.col("_prior") >= n).select(*keys, F.lit(None).cast("bigint").alias("_last"))
    return within.unionByName(used_up)


def quota(
    df: DataFrame,
    keys: Sequence[str],
    arrival: str,
    n: int,
    counts: Column | None = None,
    prior: DataFrame | None = None,
    name: str = "over_quota",
) -> DataFrame:
    """Flag rows that arrive when their creator's quota is full; rows without a creator are exempt.

    ``counts`` says which rows take a slot: none given = every row (counted when queued or decided); the rule outcome
    = only stored rows. A row is over quota iff the n-th counted row of its creator came strictly before it.
    """
    counted = df if counts is None else df.where(counts)
    cutoff = quota_cutoff(counted, keys, arrival, n, prior).withColumn("_full", F.lit(True))
    late = F.col("_full") & (F.col("_last").isNull() | (F.col(arrival) > F.col("_last")))
    exempt = F.lit(False)
    for k in keys:
        exempt = exempt | F.col(k).isNull()
    flagged = df.where(~exempt).join(cutoff, list(keys), "left").withColumn(name, F.coalesce(late, F.lit(False)))
    # rows without a creator stay out of the join: they would all be one key
    return flagged.drop("_last", "_full").select(*df.columns, name).unionByName(df.where(exempt).withColumn(name, F.lit(False)))


def fill_targets(df: DataFrame, targets: DataFrame, bucket: str, arrival: str) -> DataFrame:
    """Per bucket the first rows until its target (columns bucket, target) is reached; buckets without target drop."""
    indexed = row_index(df, arrival, "_idx", [bucket])
    return indexed.join(targets, bucket).where(F.col("_idx") < F.col("target")).drop("_idx", "target")


def cap_random(df: DataFrame, keys: Sequence[str], item: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per group in hash order: random with respect to content, the same on every run."""
    shuffled = df.withColumn("_h", hash60(seed, F.col(item)))
    return first_n(shuffled, keys, "_h", n, tie=item).drop("_h")


def sample_per_group(df: DataFrame, keys: Sequence[str], item: str, n: int, min_n: int, seed: int) -> DataFrame:
    """Fixed sample per group; groups with fewer than ``min_n`` rows are dropped."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") >= min_n).drop("_c")
    return cap_random(df.join(large, list(keys), "left_semi"), keys, item, n, seed)


def systematic_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every k-th row along ``order``, starting with the first."""
    return row_index(df, order, "_idx").where(F.col("_idx") % k == 0).drop("_idx")


def linspace_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` evenly spaced rows from the first to the last (positions truncated to whole numbers)."""
    indexed = row_index(df, order, "_idx")
    total = df.count()
    if n < 2 or total <= n:
        return indexed.where(F.col("_idx") < n).drop("_idx")
    wanted = df.sparkSession.range(n).select(F.expr(f"(id * {total - 1}L) div {n - 1}L").alias("_idx")).distinct()
    return indexed.join(wanted, "_idx", "left_semi").drop("_idx")


def disjoint_slices(df: DataFrame, item: str, slices: int, size: int, seed: int) -> DataFrame:
    """Hash permutation cut into ``slices`` disjoint pieces of ``size`` rows; every row is used at most once."""
    indexed = row_index(df.withColumn("_h", hash60(seed, F.col(item))), "_h", "_idx", ties=[item])
    return indexed.withColumn("slice", F.floor(F.col("_idx") / size).cast("int")).where(F.col("slice") < slices).drop(
        "_idx", "_h"
    )


def chrono_holdout(df: DataFrame, keys: Sequence[str], day: str, item: str, share: float = 0.9) -> DataFrame:
    """The newest rows of each group become ``val``: order by day (missing first), then item; cut at floor(share * n).

    Only the day that contains the cut is ranked by item, so a day shared by very many rows is scanned in ranges too.
    """
    keys = list(keys)
    rows = df.withColumn("_day", F.coalesce(F.datediff(F.col(day), F.lit("1900-01-01")), F.lit(-(2**31))))
    sizes = rows.groupBy(*keys).agg(F.floor(F.count("*") * F.lit(share)).alias("_cut"))
    days = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    placed = scan(days, keys, "_day", {"_upto": ("sum", F.col("_n"))}).join(sizes, keys)
    edge = placed.where((F.col("_cut") < F.col("_upto")) & (F.col("_cut") >= F.col("_upto") - F.col("_n"))).select(
        *keys, F.col("_day").alias("_edge"), (F.col("_cut") - F.col("_upto") + F.col("_n")).alias("_skip")
    )
    straddling = rows.join(edge, keys).where(F.col("_day") == F.col("_edge"))
    last = row_index(straddling, item, "_idx", keys).where(F.col("_idx") == F.col("_skip")).select(
        *keys, "_edge", F.col(item).alias("_from")
    )
    newer = (F.col("_day") > F.col("_edge")) | ((F.col("_day") == F.col("_edge")) & (F.col(item) >= F.col("_from")))
    return (
        rows.join(last, keys, "left")
        .withColumn("split", F.when(F.coalesce(newer, F.lit(False)), "val").otherwise("train"))
        .drop("_day", "_edge", "_from")
    )


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The earliest row per key; the rank limit of one is applied before the shuffle."""
    return first_n(df, keys, order, 1)
