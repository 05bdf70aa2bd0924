"""Exact top-k inner products: candidates in blocks of like length, pruned by local cosine thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import blobs, parts
from provspark.session import cut_lineage

#: Rows of a block of candidates, of a bucket of like length within it, and of a block of queries.
BLOCK, BUCKET, QUERIES = 4096, 256, 512
#: A bucket is searched by coordinates where the local threshold is at least this cosine, else by length.
STEEP = 0.5
LARGEST, NO_BOUND = 1 << 62, -(1 << 63)
#: Below it doubles hold every sum of products of integers as it is.
EXACT = 1 << 52


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null, empty or hold null or non-finite ones.

    Components of 2 ** 62 or more after scaling are an error: they are neither dropped nor cut off.
    """
    wide = F.raise_error(F.lit("top_k: a scaled component does not fit in 62 bits")).cast("long")
    scaled = lambda c: c.cast("double") * float(scale)
    x = F.transform(vector, lambda c: F.when(F.abs(scaled(c)) >= float(LARGEST), wide).otherwise(F.floor(scaled(c))))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    return F.when(fine & (F.size(vector) > 0), x)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros to ``width``."""
    inside = np.arange(width) < np.diff(column.offsets.to_numpy())[:, None]
    x = np.zeros(inside.shape, np.int64)
    x[inside] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def _pack(batches: Iterator[pa.RecordBatch], most: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``most`` rows in the order given: ids and rows of integers padded to ``width``."""
    ids, rows, held = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [blobs([np.concatenate(ids).tobytes()]), blobs([np.concatenate(rows).tobytes()])], ["ids", "rows"]
        )

    for batch in batches:
        own, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
        at = 0
        while at < len(x):
            upto = at + most - held
            ids.append(own[at:upto])
            rows.append(x[at:upto])
            held += len(rows[-1])
            at = upto
            if held == most:
                yield block()
                ids, rows, held = [], [], 0
    if held:
        yield block()


def _blocks(df: DataFrame, most: int, width: int) -> DataFrame:
    packed = df.select("id", "v").mapInArrow(lambda b: _pack(b, most, width), "ids binary, rows binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


class Queries:
    """A block of queries: what the search reads of them, and the best of each so far."""

    def __init__(self, ids: bytes, rows: bytes, width: int):
        self.ids, self.x = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, width)
        self.size = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.unit = self.x / np.maximum(self.size, 1e-300)[:, None]
        self.telling = np.argsort(-np.abs(self.unit), axis=1)[:, :2]  # their longest coordinates
        self.best_ids, self.best = ([np.zeros(0, np.int64)] * len(self.ids) for _ in range(2))

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray, k: int) -> int:
        """The best ``k`` of what there was and these; their least score, if there are so many."""
        ids, best = np.concatenate([self.best_ids[q], ids]), np.concatenate([self.best[q], scores])
        if len(best) > k:
            order = np.lexsort((ids, -best)) if best.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-best[i], ids[i])), np.int64)
            ids, best = ids[order[:k]], best[order[:k]]
        self.best_ids[q], self.best[q] = ids, best
        least = int(best.min()) if len(best) == k else NO_BOUND
        return least if least >= NO_BOUND else NO_BOUND


class Candidates:
    """One block: buckets of like length, longest first, with unit vectors for the pruning."""

    def __init__(self, ids: bytes, rows: bytes, width: int):
        x = np.frombuffer(rows, np.int64).reshape(-1, width)
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.x, self.length = np.frombuffer(ids, np.int64)[order], x[order], length[order]
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]

    def search(self, queries: Queries, least: np.ndarray, k: int) -> np.ndarray:
        """Each query gets this block's k best among those that score at least its ``least``; later buckets need more.
        Returns what they need in the end."""
        least = least.copy()
        for a in range(0, len(self.ids), BUCKET):
            rows = slice(a, min(a + BUCKET, len(self.ids)))
            asking = np.flatnonzero((least <= 0) | (queries.size * self.length[a] >= least * (1 - 1e-9)))
            if not len(asking):
                break  # this bucket and all shorter ones stay below
            good = self._within(rows, queries, asking, least[asking]) & (self.ids[rows] != queries.ids[asking, None])
            asking, good = asking[good.any(axis=1)], good[good.any(axis=1)]
            scores = self._products(rows, queries.x[asking], queries.size[asking].max(initial=0) * self.length[a])
            good &= (scores >= least[asking, None]) | (least[asking, None] == NO_BOUND)
            for n in np.flatnonzero(good.any(axis=1)):
                q, hit = asking[n], np.flatnonzero(good[n])
                now = queries.add(q, self.ids[a + hit], scores[n, hit], k)
                least[q] = max(least[q], min(now, -NO_BOUND - 1))
        return least

    def _products(self, rows: slice, asked: np.ndarray, bound: float) -> np.ndarray:
        """Exact products, a row for each query: the bound on their size tells whether doubles hold all sums of integers
        as they are, or longs do; others are taken in integers of any size."""
        if bound < EXACT:
            return (asked.astype(float) @ self.x[rows].T.astype(float)).astype(np.int64)
        if bound < LARGEST:
            return asked @ self.x[rows].T
        return asked.astype(object) @ self.x[rows].T.astype(object) if len(asked) else np.zeros((0, rows.stop - rows.start), object)

    def _within(self, rows: slice, queries: Queries, asking: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which rows of a bucket can reach each query's threshold: those that are long enough, or, where that is a cosine
        of ``STEEP`` or more, those whose coordinates are where a vector within it must have the query's two longest."""
        size = queries.size[asking]
        floor = np.where(least > 0, least * (1 - 1e-9), -np.inf)
        good = size[:, None] * self.length[rows] >= floor[:, None]
        cosine = np.where(least > 0, least / np.maximum(size * self.length[rows.start], 1e-300), 0.0)
        steep = np.flatnonzero(cosine >= STEEP)
        cosine, unit = np.minimum(cosine[steep], 1.0), queries.unit[asking[steep]]
        for f in queries.telling[asking[steep]].T:
            of = unit[np.arange(len(f)), f]
            side = np.sqrt(np.maximum(0.0, 1 - of**2) * (1 - cosine**2))
            low = np.where(of <= -cosine, -1.0, of * cosine - side)
            high = np.where(of >= cosine, 1.0, of * cosine + side)
            there = self.unit[rows].T[f]
            good[steep] &= (there >= low[:, None] - 1e-9) & (there <= high[:, None] + 1e-9)
        return good


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the ``k`` largest integer products of every query with all other rows.

    Ties go to the smaller id. Fewer candidates give fewer rows; rows without an id or a usable vector take no part; of
    rows that repeat an id the least vector counts; shorter vectors count as filled with zeros.

    Candidates are range-split by length into blocks of ``BLOCK`` rows. Every query meets the block of the longest ones
    first, whose k-th best score bounds its result from below; then each block of queries goes to every slot of blocks, where
    buckets are left out or searched by coordinates or lengths under the threshold that the bound gives them.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector)).alias("v"), is_query.alias("q"))
    rows = usable.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = cut_lineage(rows.withColumn("length", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    found = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not found["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, n = found["width"], found["n"]
    n_parts = max(1, min(parts(spark), n // BLOCK + 1))
    ranged = rows.repartitionByRange(n_parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    blocks = _blocks(ranged, BLOCK, width)
    queries = _blocks(rows.where("q").repartition(max(1, n_parts // 4)), QUERIES, width)

    longest = spark.sparkContext.broadcast(tuple(blocks.agg(F.min_by(F.struct("ids", "rows"), "block")).first()[0]))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Candidates(*longest.value, width)  # one of BLOCK rows
        for batch in batches:
            out = []
            for ids, rows in zip(batch.column("ids").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                asked = Queries(ids, rows, width)
                out.append(block.search(asked, np.full(len(asked.ids), NO_BOUND), k).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("rows"), blobs(out)], ["q_ids", "q_rows", "bound"]
            )

    def long(scores: np.ndarray) -> np.ndarray:
        if len(scores) and (scores.max() > -NO_BOUND - 1 or scores.min() < NO_BOUND):
            raise OverflowError("top_k: a score does not fit in a long")
        return scores.astype(np.int64)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked = Queries(r["q_ids"], r["q_rows"], width)
                Candidates(r["ids"], r["rows"], width).search(asked, np.frombuffer(r["bound"], np.int64), k)
                q = [np.full(len(v), i) for i, v in zip(asked.ids, asked.best_ids, strict=True)]
                v, s = asked.best_ids, [long(x) for x in asked.best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (q, v, s)], ["query_id", "vec_id", "score"]
                )

    slots = parts(spark)
    asked = queries.mapInArrow(bounds, "q_ids binary, q_rows binary, bound binary")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    held = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    hits = asked.join(held, "slot").drop("slot", "block").mapInArrow(seek, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
