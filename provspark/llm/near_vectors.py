"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import with_nodes
from provspark.llm.components import components
from provspark.operators.scan import row_index
from provspark.session import cut_lineage

#: Rows of a window, bits of a code that is sorted (a bucket's prefix comes first), windows that are compared in one group.
WINDOW, BITS, SPAN = 128, 40, 8
#: A pair at the least cosine of interest is missed with at most about this chance.
MISS = 0.005


def passes_for(n: int, at_least: float = 0.9) -> tuple[int, int]:
    """(passes, bits of a bucket): a bucket of unlike vectors has about a window's rows, and passes make up for the
    pairs that such a prefix parts. Both grow with the number of rows, passes also as ``at_least`` falls: a pair of that
    cosine agrees in a bit with the chance 1 - acos(at_least) / pi."""
    bits = max(1, min(BITS, math.ceil(math.log2(max(2, n / WINDOW)))))
    agree = 1 - math.acos(max(-1.0, min(1.0, at_least))) / math.pi
    if agree <= 0:
        raise ValueError("no number of passes finds opposite vectors")
    parted = -math.expm1(bits * math.log(agree))
    return max(4, math.ceil(math.log(MISS) / math.log(parted)) if parted > 0 else 0), bits


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, filled with zeros to the same width, and their sizes."""
    size = np.diff(column.offsets.to_numpy())
    inside = np.arange(size.max(initial=0)) < size[:, None]
    x = np.zeros(inside.shape)
    x[inside] = column.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, size


def _codes(batches: Iterator[pa.RecordBatch], n_passes: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in filter(len, batches):
        units, size = _units(batch.column("v"))
        code = np.zeros((len(units), n_passes), np.int64)
        for width in np.unique(size).tolist():
            if width not in planes:
                planes[width] = np.random.default_rng([seed, width]).normal(size=(width, n_passes * BITS))
            rows = np.flatnonzero(size == width)
            sign = (units[rows, :width] @ planes[width] >= 0).reshape(len(rows), n_passes, BITS)
            code[rows] = sign @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * n_passes), pa.array(code.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), out], ["id", "codes"])


def _pairs(t: pa.Table, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs (i, j) of the rows of a group, and which of them no earlier pass compares.

    Rows meet those of their block and of the next one; in a group of one bucket, those of the other block only.
    """
    x, size = _units(t.column("v").chunk(0))
    block, in_bucket = t.column("block").to_numpy(), t.column("in_bucket")[0].is_valid
    blocks, at = np.unique(block, return_inverse=True)
    members = [np.flatnonzero(at == k) for k in range(len(blocks))]
    if in_bucket:
        meet = [(0, 1)] if len(blocks) > 1 else []
    else:
        own = [k for k in range(len(blocks)) if blocks[k] // SPAN == t.column("tile")[0].as_py()]  # the rest is compared in the next group
        meet = [(k, k) for k in own] + [(k, k + 1) for k in own if k + 1 < len(blocks) and blocks[k + 1] == blocks[k] + 1]
    found = [np.zeros((2, 0), np.int64)]
    for a, b in meet:
        near = x[members[a]] @ x[members[b]].T >= at_least
        i, j = np.nonzero(np.triu(near, 1) if a == b else near)
        found.append(np.stack([members[a][i], members[b][j]]))
    i, j = np.concatenate(found, axis=1)
    alike = size[i] == size[j]  # vectors of other lengths never link
    i, j = i[alike], j[alike]
    blocks_of, buckets_of = (t.column(c).chunk(0).flatten().to_numpy().reshape(len(x), -1) for c in ("blocks", "buckets"))
    new = np.ones(len(i), bool)
    for q in range(blocks_of.shape[1]):
        new &= (buckets_of[i, q] != buckets_of[j, q]) & (np.abs(blocks_of[i, q] - blocks_of[j, q]) > 1)
    return i, j, new


def neighbours(rows: DataFrame) -> DataFrame:
    """The rows in groups of neighbouring blocks, for each pass: the first block of a span ends the span before, too."""
    span = F.floor(F.col("block") / SPAN).cast("int")
    spans = F.when((F.col("block") % SPAN == 0) & (F.col("block") > 0), F.array(span, span - 1)).otherwise(F.array(span))
    placed = rows.select("*", F.posexplode("blocks").alias("pass", "block")).withColumn("tile", F.explode(spans))
    return placed.withColumns({"other": F.lit(-1), "in_bucket": F.lit(None).cast("long")})


def links(distinct: DataFrame, at_least: float, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``distinct`` (id, v, weight: rows that share the vector) -> counts (id, n) and edges (a, b) that join what links.

    Each pass sorts all vectors by a code of ``BITS`` signs of random projections and cuts the order into blocks of
    ``WINDOW`` rows. Compared are rows of one block, of neighbouring blocks, and of one bucket (equal first bits of the
    code), however large: a bucket over more blocks is compared block by block. A group holds ``SPAN`` blocks and the one
    that follows, so a row travels little more than once in a pass. A pair that several passes compare is counted in the
    first of them: which that is follows from the blocks and buckets of earlier passes, which each row carries. Edges are a
    spanning forest of each group's links, so no task emits the pairs of a group.
    """
    n = distinct.count()
    n_passes, bits = passes_for(n, at_least)
    shift = BITS - bits
    codes = distinct.mapInArrow(lambda b: _codes(b, n_passes, bits, seed), "id long, codes array<bigint>")
    long = cut_lineage(codes.select("id", F.posexplode("codes").alias("pass", "code")))
    spread = F.col("code") * float(1 << 12) + F.pmod(F.xxhash64("id"), F.lit(1 << 12))  # parts equal codes; exact in a double
    placed = row_index(long.withColumn("place", spread.cast("double")), "place", "idx", keys=["pass"], ties=["id"])
    placed = placed.select(
        "id", "pass", F.floor(F.col("idx") / WINDOW).cast("int").alias("block"),
        F.shiftright("code", shift).alias("bucket"),
    )
    placed = cut_lineage(placed)
    carried = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "bucket"))).alias("p"))
    rows = cut_lineage(distinct.join(carried, "id").select(
        "id", "v", "weight", F.col("p.block").alias("blocks"), F.col("p.bucket").alias("buckets")
    ))
    # pairs of blocks that only a bucket joins
    wide = placed.groupBy("pass", "bucket").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    wide = wide.where("high - low >= 2")
    far = placed.join(wide, ["pass", "bucket"]).select(
        "id", "pass", "block", F.explode(F.sequence("low", "high")).alias("o"), F.col("bucket").alias("in_bucket")
    ).where("abs(o - block) >= 2")
    far = far.select("id", "pass", "block", F.least("o", "block").alias("tile"), F.greatest("o", "block").alias("other"), "in_bucket")
    met = neighbours(rows).unionByName(far.join(rows, "id"))
    met = met.withColumns({c: F.slice(c, 1, F.col("pass")) for c in ("blocks", "buckets")})

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j, new = _pairs(t, at_least)
        id_, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        ids, place = np.unique(np.concatenate([id_[i], id_[j]]), return_inverse=True)
        u, v = place[: len(i)], place[len(i) :]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, u[new], weight[j[new]])
        np.add.at(count, v[new], weight[i[new]])
        root = np.arange(len(ids))
        while True:  # least label of linked rows, until none falls
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.table({"id": ids, "n": count, "to": ids[root]})

    # one row per group and member; a group has at most SPAN + 1 blocks
    found = met.groupBy("pass", "tile", "other", "in_bucket").applyInArrow(compare, "id long, n long, to long")
    found = cut_lineage(found)
    return (
        found.groupBy("id").agg(F.sum("n").alias("n")),
        found.select(F.col("id").alias("a"), F.col("to").alias("b")).where("a <> b"),
    )


def near_duplicates(vectors: DataFrame, at_least: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row: rows with a cosine of ``at_least`` link, components by links.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing:
    they are components of their own. Rows with the same vector are compared once and count as linked. Vectors that share
    an id have their own links each, and one component. Vectors of different lengths never link.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    digest = F.concat_ws(" ", F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    good, bits = with_nodes(ids.where(F.col("id").isNotNull() & usable(F.col("v"))), digest)
    classes = cut_lineage(good.groupBy("v").agg(F.min("node").alias("id"), F.count("*").alias("weight")))
    counts, edges = links(classes, at_least)
    member = good.join(classes.select("v", F.col("id").alias("rep"), "weight"), "v").select("id", "rep", "weight")
    if bits:  # an id joins its vectors
        first = member.groupBy("id").agg(F.min("rep").alias("b"))
        edges = edges.unionByName(member.join(first, "id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct())
    groups = components(edges)
    known = (
        member.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.shiftright(F.coalesce("component", "rep"), bits).alias("component_id"),
        )
    )
    rest = ids.where(F.col("id").isNull() | ~usable(F.col("v"))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    out = known.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)
