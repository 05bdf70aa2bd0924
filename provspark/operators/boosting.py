"""Boosted trees over a few nuisance columns, from the counts of distinct binned rows.

Trees that split on bins see of a table only how often each combination of bins occurs with each label. Spark counts
these in one aggregation with map-side combine; their number has a bound, whatever the rows, so hundreds of trees cost
sums over that small table instead of passes over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most combinations of bins, which all come to the driver, and bins of a column.
CELLS, BINS = 1 << 20, 256
CELL = "_cell"


def bin_edges(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Inner edges of each column's bins at even quantiles of ``df``: as many as keep their combinations below ``CELLS``.

    One more bin of each column is for nulls and NaN."""
    bins = min(BINS, int(CELLS ** (1 / len(columns)))) - 1
    if bins < 2:
        raise ValueError(f"{len(columns)} columns are too many to be probed together")
    probs = [i / bins for i in range(1, bins)]
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = known.approxQuantile(list(columns), probs, 1e-4)
    return [sorted(set(e)) for e in found]


def with_cells(df: DataFrame, columns: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with the number of each row's combination of bins; an unknown value is a bin of its own, and no row drops."""
    cell = F.lit(0).cast("bigint")
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        value = F.col(f"`{c}`").cast("double")
        df = df.withColumn(f"_x{i}", F.when(value.isNull(), F.lit(float("nan"))).otherwise(value))
        splits = [-float("inf"), *e, float("inf")]
        df = Bucketizer(splits=splits, inputCol=f"_x{i}", outputCol=f"_b{i}", handleInvalid="keep").transform(df)
        cell = cell * (len(e) + 2) + F.col(f"_b{i}").cast("bigint")
    drop = [f"_{k}{i}" for i in range(len(columns)) for k in "xb"]
    return df.withColumn(CELL, cell).drop(*drop)


def unpacked(cells: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins of each column of the given cells."""
    out = np.zeros((len(cells), len(edges)), np.int64)
    rest = cells.copy()
    for i in range(len(edges) - 1, -1, -1):
        out[:, i], rest = rest % (len(edges[i]) + 2), rest // (len(edges[i]) + 2)
    return out


def boosted_scores(
    bins: np.ndarray, clean: np.ndarray, hit: np.ndarray, trees: int = 300, depth: int = 4, rate: float = 0.05,
    rows: float = 0.8, columns: float = 0.8, seed: int = 1,
) -> np.ndarray:
    """Log odds of each row of bins, fitted to the counts of label 0 and 1 (rows without counts are scored only).

    Second-order boosting on the logistic loss with one unit of L2 penalty and of least weight in a leaf; each tree sees a
    share of the rows (drawn from the counts) and of the columns.
    """
    rng = np.random.default_rng(seed)
    score = np.zeros(len(bins))
    width = int(bins.max(initial=0)) + 1
    some = max(1, round(columns * bins.shape[1]))
    for _ in range(trees):
        n0, n1 = (rng.binomial(c, rows).astype(float) for c in (clean, hit))
        p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        g, h = (n0 + n1) * p - n1, (n0 + n1) * p * (1 - p)
        node = np.zeros(len(bins), np.int64)
        chosen = rng.choice(bins.shape[1], some, replace=False)
        for level in range(depth):
            nodes = 1 << level
            best = np.zeros(nodes)
            column, cut = np.full(nodes, -1), np.full(nodes, width)
            for c in chosen:
                key = node * width + bins[:, c]
                left_g, left_h = (np.bincount(key, x, nodes * width).reshape(nodes, width).cumsum(1) for x in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < 1) | (right_h < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best + 1e-12
                best[better], column[better], cut[better] = top[better], c, at[better]
            split = column[node]
            value = bins[np.arange(len(bins)), np.maximum(split, 0)]
            node = node * 2 + ((split >= 0) & (value > cut[node]))
        total_g, total_h = (np.bincount(node, x, 1 << depth) for x in (g, h))
        score -= rate * (total_g / (total_h + 1))[node]
    return score


def probe_scores(df: DataFrame, columns: Sequence[str], group: str, trees: int, depth: int) -> DataFrame:
    """(grp, label, score, times) of the test rows of ``df`` (label, split, columns) under trees fitted to its training
    rows: a histogram, which reports take in place of rows."""
    known = df.where("split in ('train', 'test')")
    edges = bin_edges(known.where("split = 'train'"), columns)
    placed = with_cells(known.select("label", "split", F.col(group).alias("grp"), *columns), columns, edges)
    counted = placed.groupBy(CELL).agg(
        F.count_if((F.col("split") == "train") & (F.col("label") == 0)).alias("n0"),
        F.count_if((F.col("split") == "train") & (F.col("label") == 1)).alias("n1"),
    )
    cells = counted.orderBy(CELL).collect()  # at most CELLS
    number, n0, n1 = (np.array([r[c] for r in cells], np.int64) for c in (CELL, "n0", "n1"))
    scores = boosted_scores(unpacked(number, edges), n0, n1, trees, depth)
    told = df.sparkSession.createDataFrame(
        [(int(c), float(s)) for c, s in zip(number, scores, strict=True)], f"{CELL} bigint, score double"
    )
    test = placed.where("split = 'test'").groupBy("grp", "label", CELL).agg(F.count("*").alias("n"))
    return test.join(told, CELL).groupBy("grp", "label", "score").agg(F.sum("n").alias("times"))
