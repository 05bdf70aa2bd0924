"""Exact order statistics by radix select: a fixed number of digit counts, the same at every size.

A double becomes an integer of the same order (its IEEE bits, negated below zero), and each pass counts one digit of it.
Counts combine map-side, so a task ships at most one row per key, digit and open prefix, whatever its rows hold; the
digit that holds a wanted position is the prefix of the next pass, which reads only rows behind it. The table itself is
read twice: for the first digits (sign, exponent, ten bits more), and for the distinct values behind those that hold a
target, which the last two passes count. Every key and every target goes through the same passes. Order: -inf < finite < inf < NaN; -0.0 equals 0.0; nulls take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators.histogram import times
from provspark.session import cut_lineage, settle

DIGITS = (22, 21, 21)
LARGEST = 1.7976931348623157e308
INFINITY, NAN = 0x7FF0000000000000, 0x7FF8000000000000
TOLERANCE = 1e-12
KEY, PREFIX, DIGIT = "_key", "_prefix", "_digit"


def ordered_bits(x: Column) -> Column:
    """The integer whose order is that of the double; null for null."""
    size = F.least(F.abs(x), F.lit(LARGEST))
    guess = F.floor(F.coalesce(F.log2(size), F.lit(-1022.0))).cast("int")
    # a logarithm is rounded: beside a power of two it may be one off
    exponent = guess + F.when(size < _power(guess), -1).when(size >= _power(guess + 1), 1).otherwise(0)
    exponent = F.least(F.greatest(exponent, F.lit(-1022)), F.lit(1023))
    fraction = (size / _power(exponent) * F.lit(2.0**52)).cast("bigint")  # exact: powers of two only
    bits = F.shiftleft((exponent + 1022).cast("bigint"), 52) + fraction
    bits = F.when(F.isnan(x), F.lit(NAN)).when(F.abs(x) == float("inf"), F.lit(INFINITY)).otherwise(bits)
    return F.when(x.isNotNull(), F.when(x < 0, -bits).otherwise(bits))


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def _keyed(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, the value as ``_x``, its integer, and how many rows a row stands for as ``_t``."""
    x = F.col(value).cast("double")
    return df.select(*by, (x + 0.0).alias("_x"), ordered_bits(x).alias(KEY), times(df).alias("_t"))


def _digit(level: int) -> Column:
    below = sum(DIGITS[level + 1 :])
    digit = F.shiftright(KEY, below)
    return digit if level == 0 else digit.bitwiseAND(F.lit((1 << DIGITS[level]) - 1))


def _behind(rows: DataFrame, keys: Sequence[str], level: int, open_: DataFrame) -> DataFrame:
    """Rows whose leading digits are a prefix still open for their key, beside what is wanted there."""
    sought = open_.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    same = F.shiftright(KEY, sum(DIGITS[level:])) == F.col(PREFIX)
    return rows.join(sought, _same(keys) & same).drop(*[f"_o_{k}" for k in keys])


def _tail_counts(rows: DataFrame, keys: Sequence[str], by: Sequence[str], open_: DataFrame) -> DataFrame:
    """Distinct values behind the first digits and how often each occurs, checkpointed: the later passes read these."""
    behind = _behind(rows, keys, 1, open_)
    return cut_lineage(behind.groupBy(*by, KEY).agg(F.min("_x").alias("_x"), F.sum("_t").alias("_t")))


def _same(keys: Sequence[str]) -> Column:
    """Null keys are keys too, as in a grouping."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return same


def _next_prefix(level: int) -> Column:
    return F.col(PREFIX) * F.lit(1 << DIGITS[level]) + F.col(DIGIT)


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Column, count: str = "n") -> DataFrame:
    """The values at the wanted 0-based ascending positions within each key, one row per key and position.

    ``ranks`` is an array of positions over the row count ``count`` of the key; positions outside it give no row.
    Columns: keys, ``count``, ``i`` (place in the array), ``rank``, ``value``, ``below`` (rows under the value),
    ``peers`` (rows at it). An empty table gives no row.
    """
    keys = list(keys)
    rows = _keyed(df, keys, value).where(F.col(KEY).isNotNull())
    behind, carried = rows.withColumn(PREFIX, F.lit(0).cast("bigint")), []
    for level in range(len(DIGITS)):
        counted = behind.groupBy(*keys, PREFIX, *carried, _digit(level).alias(DIGIT)).agg(
            F.sum("_t").alias("_m"), F.min("_x").alias("_v")
        )
        if level == 0:
            start = F.transform(ranks, lambda r, i: F.struct(i.alias("i"), r.cast("bigint").alias("rank"), r.cast("bigint").alias("left")))
            whole = F.sum("_m").over(Window.partitionBy(*keys, PREFIX))
            counted = counted.withColumn(count, whole).withColumn("_wanted", start)
        below = F.sum("_m").over(Window.partitionBy(*keys, PREFIX).orderBy(DIGIT)) - F.col("_m")
        placed = counted.withColumn("_below", below)
        moved = F.transform("_wanted", lambda w: w.withField("left", w["left"] - F.col("_below")))
        inside = F.filter(moved, lambda w: (w["left"] >= 0) & (w["left"] < F.col("_m")))
        found = placed.withColumn("_wanted", inside).where(F.size("_wanted") > 0)
        if level + 1 < len(DIGITS):
            carried = [count, "_wanted"]
            open_ = found.select(*keys, *carried, _next_prefix(level).alias(PREFIX))
            if level == 0:
                open_ = settle(open_)
                rows = _tail_counts(rows, keys, keys, open_)
            behind = _behind(rows, keys, level + 1, open_)
    return found.select(*keys, count, F.explode("_wanted").alias("w"), "_v", "_m").select(
        *keys,
        count,
        F.col("w.i").alias("i"),
        F.col("w.rank").alias("rank"),
        F.col("_v").alias("value"),
        (F.col("w.rank") - F.col("w.left")).alias("below"),
        F.col("_m").alias("peers"),
    )


def select_mean_tail(df: DataFrame, keys: Sequence[str], group: str, value: str, targets: Sequence[float]) -> DataFrame:
    """The least value whose strict exceedance, averaged over the groups of its key with equal weight, is at most each
    target: columns keys, ``target``, ``threshold``.

    Rows without a value count in the size of their group and exceed nothing. The first count of digits also gives the
    sizes. Rounding of the weights is forgiven up to ``TOLERANCE``.
    """
    keys = list(keys)
    by = [*keys, group]
    every = _keyed(df, by, value)
    first = cut_lineage(
        every.groupBy(*by, _digit(0).alias(DIGIT)).agg(F.sum("_t").alias("_m"), F.min("_x").alias("_v"))
    )
    sizes = first.groupBy(*by).agg(F.sum("_m").alias("_n"))
    groups = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g")).withColumnsRenamed({k: f"_o_{k}" for k in keys})
    share = (1.0 / (F.col("_g") * F.col("_n"))).alias("_share")
    shares = settle(sizes.join(groups, _same(keys)).select(*[F.col(k).alias(f"_o_{k}") for k in by], share))
    rows = every.where(F.col(KEY).isNotNull())
    start = [
        F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("target"), F.lit(0.0).alias("above"))
        for i, f in enumerate(targets)
    ]
    counted = (
        first.where(F.col(DIGIT).isNotNull())
        .withColumn(PREFIX, F.lit(0).cast("bigint"))
        .withColumn("_wanted", F.array(*start))
    )
    for level in range(len(DIGITS)):
        weighed = (
            counted.join(shares, _same(by))
            .groupBy(*keys, PREFIX, "_wanted", DIGIT)
            .agg(F.sum(F.col("_share") * F.col("_m")).alias("_w"), F.min("_v").alias("_v"))
        )
        over = Window.partitionBy(*keys, PREFIX).orderBy(F.col(DIGIT).desc())
        over = over.rowsBetween(Window.unboundedPreceding, -1)
        placed = weighed.withColumn("_above", F.coalesce(F.sum("_w").over(over), F.lit(0.0)))
        moved = F.transform("_wanted", lambda w: w.withField("above", w["above"] + F.col("_above")))
        fits = F.filter(moved, lambda w: w["above"] <= w["target"] + TOLERANCE)
        best = (
            placed.select(*keys, PREFIX, DIGIT, "_v", F.explode(fits).alias("w"))
            .groupBy(*keys, F.col("w.i").alias("i"))
            .agg(F.min(F.struct(DIGIT, PREFIX, "w", "_v")).alias("b"))
            .select(*keys, "b.*")
        )
        if level + 1 < len(DIGITS):
            open_ = best.groupBy(*keys, _next_prefix(level).alias(PREFIX)).agg(F.collect_list("w").alias("_wanted"))
            if level == 0:
                open_ = settle(open_)
                rows = _tail_counts(rows, keys, by, open_)
            behind = _behind(rows, keys, level + 1, open_)
            counted = behind.groupBy(*by, PREFIX, "_wanted", _digit(level + 1).alias(DIGIT)).agg(
                F.sum("_t").alias("_m"), F.min("_x").alias("_v")
            )
    return best.select(*keys, F.col("w.target").alias("target"), F.col("_v").alias("threshold"))
