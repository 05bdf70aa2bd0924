"""Split assignment for whole groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.scan import row_index

# Wanted shares in twentieths; on equal deficits the first named split is served.
SHARES = {"test": 3, "val": 2, "train": 15}


def _before(total: int, step: int, weight: int, other_total: int, other_weight: int, i: int, other_first: bool) -> int:
    """Turns another split takes before this split takes its i-th turn in a run of equal groups."""
    top = (total + i * step) * other_weight - other_total * weight
    under = step * weight
    return max(0, top // under + 1) if other_first else max(0, -(-top // under))


def greedy_group_split(df: DataFrame, group: str, shares: Mapping[str, int] = SHARES) -> DataFrame:
    """Whole groups to splits, largest first, each to the split with the largest relative deficit.

    Ties between groups of one size follow crc32 of the name. The greedy order depends only on sizes, so the driver
    walks the histogram of sizes (its length is at most the square root of twice the row count) and keeps one total per
    split. Within a run of equal sizes the turns of the splits interleave by a closed form; the runs are expanded and
    matched to the ranked groups on the executors.
    """
    spark = df.sparkSession
    names = list(shares)
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    histogram = sizes.groupBy("size").count().orderBy(F.col("size").desc()).collect()
    have = dict.fromkeys(names, 0)
    runs = []
    for size, m in ((r["size"], r["count"]) for r in histogram):

        def place(j: int, i: int, size: int = size) -> int:
            s = names[j]
            return i + sum(
                _before(have[s], size, shares[s], have[o], shares[o], i, k < j) for k, o in enumerate(names) if k != j
            )

        taken = {}
        for j, s in enumerate(names):
            lo, hi = 0, m
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if place(j, mid) < m else (lo, mid)
            taken[s] = lo
        for j, s in enumerate(names):
            if taken[s]:
                others = [(have[o], shares[o], k < j) for k, o in enumerate(names) if k != j]
                runs.append((size, s, taken[s], have[s], shares[s], others))
        for s in names:
            have[s] += taken[s] * size
    schema = (
        "size bigint, split string, turns bigint, total bigint, weight bigint, "
        "others array<struct<total: bigint, weight: bigint, first: boolean>>"
    )
    table = spark.createDataFrame(runs, schema).select("*", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("i"))
    top = "((total + i * size) * o.weight - o.total * weight)"
    under = "(size * weight)"
    whole = f"(({top} - pmod({top}, {under})) div {under})"
    before = (
        f"greatest(0L, CASE WHEN o.first THEN {whole} + 1 "
        f"ELSE {whole} + CASE WHEN pmod({top}, {under}) = 0 THEN 0 ELSE 1 END END)"
    )
    turns = table.select("size", "split", F.expr(f"i + aggregate(others, 0L, (a, o) -> a + {before})").alias("turn"))
    ordered = row_index(
        sizes.withColumn("_crc", F.crc32(F.encode(F.col(group), "utf-8"))), "_crc", "turn", ["size"], ties=[group]
    )
    return ordered.join(turns, ["size", "turn"]).select(group, "size", "split")


def inherit_split(derived: DataFrame, base: DataFrame, on: str, models: Sequence[str] | None = None) -> DataFrame:
    """Derived rows take split and group of their base row; without a base row they drop."""
    kept = derived if models is None else derived.where(F.col("model").isin(*models))
    return kept.join(base.select(on, "split", "grp"), on)


def disjoint_creators(train: DataFrame, test: DataFrame, creator: str) -> DataFrame:
    """Training rows whose creator does not occur in the test manifest; missing creators are ignored there."""
    held_out = test.where(F.col(creator).isNotNull() & (F.col(creator) != "")).select(creator).distinct()
    # rows without a creator never match; in the join they would all be one key
    known = train.where(F.col(creator).isNotNull()).join(held_out, creator, "left_anti").select(*train.columns)
    return known.unionByName(train.where(F.col(creator).isNull()))
