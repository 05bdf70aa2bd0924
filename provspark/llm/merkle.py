"""Merkle manifest of a dataset: ternary hash trees of any size, kept as aligned blocks in van Emde Boas layout.

A digest is the lower-case hex sha256 of its inputs, one behind the other; inputs that are digests count as hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import blobs, tidied
from provspark.session import cut_lineage, partitions

#: Children of a node, and levels of edges of a block: ARITY ** HEIGHT leaves.
ARITY, HEIGHT = 3, 6
#: Bytes of a digest in a block.
DIGEST = 32
BLOCKS = "grp string, block long, total long, nodes binary, root binary"
PATHS = "grp string, pos long, above binary, subroot binary"


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Place of the node ``index`` of ``depth`` (0: the root) in the van Emde Boas layout of a tree of ``levels`` levels.

    The upper half of the levels comes first, as a tree laid out in the same way, then its subtrees, one by one, each in
    the same way: any path is in few pieces, whatever the size of a cache line.
    """
    at = 0
    while levels > 1:
        top = levels // 2
        low = levels - top
        if depth < top:
            levels = top
            continue
        below = ARITY ** (depth - top)
        at += nodes_of(top) + index // below * nodes_of(low)
        levels, depth, index = low, depth - top, index % below
    return at


def height_of(leaves: int) -> int:
    """Levels of edges above so many leaves, in a block: until one node remains, or all of a block's."""
    h = 0
    while ARITY**h < leaves and h < HEIGHT:
        h += 1
    return h


def digest(*parts: bytes) -> bytes:
    """Digest of digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def layout(leaves: list[bytes], height: int) -> bytes:
    """The nodes above ``leaves``, and these, in van Emde Boas layout; places of missing nodes hold zeros."""
    out = bytearray(nodes_of(height + 1) * DIGEST)
    level = leaves
    for depth in range(height, -1, -1):
        for i, d in enumerate(level):
            at = address(height + 1, depth, i) * DIGEST
            out[at : at + DIGEST] = d
        if depth:
            level = [digest(*level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
    return bytes(out)


def siblings(nodes: bytes, leaves: int, height: int, leaf: int) -> bytes:
    """The path from a leaf to the root of its block: for each level how many siblings are left and right of the node, as
    two bytes, and these siblings."""
    out, count, i = [], leaves, leaf
    for depth in range(height, 0, -1):
        first = i - i % ARITY
        run = [address(height + 1, depth, j) * DIGEST for j in range(first, min(first + ARITY, count)) if j != i]
        out.append(bytes((i - first, len(run) - (i - first))))
        out.extend(bytes(nodes[a : a + DIGEST]) for a in run)
        i, count = i // ARITY, -(-count // ARITY)
    return b"".join(out)


def levels_of(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(left, right) siblings of each level of a path."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        ends = [path[a : a + DIGEST] for a in range(at + 2, at + 2 + (left + right) * DIGEST, DIGEST)]
        yield ends[:left], ends[left:]
        at += 2 + (left + right) * DIGEST


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for left, right in levels_of(path):
        leaf = digest(*left, leaf, *right)
    return leaf


def path_digest(path: bytes) -> str:
    """Hex digest of all siblings of a path, level by level, left to right."""
    return hashlib.sha256("".join(d.hex() for left, right in levels_of(path) for d in (*left, *right)).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as part of a leaf: ``-`` for null, else the count of its UTF-8 bytes, a colon, and these."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Binary digest of a row's values."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (grp not null, ...) with ``pos``, from 0 in ``order`` within grp, and ``total``, the rows of grp.

    Rows are range-split by grp and order and fixed there, so that a large group lies in as many ranges as it needs; only
    the sizes of the ranges, a row for each range and group, are summed along a group.
    """
    n = max(2, partitions(rows.sparkSession))
    split = rows.repartitionByRange(n, F.col("grp"), *order).withColumn("_range", F.spark_partition_id())
    split = cut_lineage(split)
    own = Window.partitionBy("grp", "_range").orderBy(*order)
    sizes = split.groupBy("grp", "_range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("grp"), F.col("_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(whole).alias("total")
    )
    numbered = split.withColumn("pos", F.row_number().over(own).cast("long") - 1).join(sizes, ["grp", "_range"])
    return numbered.withColumn("pos", F.col("pos") + F.col("_before")).drop("_range", "_before")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves sorted by grp, block and pos -> one row per block."""
    now, leaves, out = None, [], []

    def close() -> None:
        grp, block, total = now
        height = height_of(total)
        nodes = layout(leaves, height)
        out.append((grp, block, total, nodes, nodes[:DIGEST]))

    def ready() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "block", "total", "nodes", "root"])

    for batch in batches:
        each = (batch.column(c).to_pylist() for c in ("grp", "block", "total", "leaf"))
        for grp, block, total, leaf in zip(*each, strict=True):
            if now != (grp, block, total):
                if now is not None:
                    close()
                now, leaves = (grp, block, total), []
            leaves.append(leaf)
            if len(out) >= 64:
                yield ready()
    if now is not None:
        close()
    if out:
        yield ready()


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a block in one task, in order; a block has a bounded number of leaves."""
    n = max(2, partitions(rows.sparkSession))
    return rows.repartition(n, "grp", "block").sortWithinPartitions("grp", "block", *order)


def build(rows: DataFrame) -> list[DataFrame]:
    """The blocks (``BLOCKS``) of the trees over (grp, pos, total, leaf), tier by tier.

    The first tier has the rows as leaves, each further one the roots of the blocks of those groups that have several. A
    group with no more leaves than a block has one block, no higher than it must be, whose root is the group's.
    """
    most = rows.agg(F.max("total")).first()[0] or 0
    tiers, size = [], ARITY**HEIGHT
    while True:
        placed = rows.select("grp", "pos", "total", "leaf", F.floor(F.col("pos") / size).cast("long").alias("block"))
        blocks = cut_lineage(dealt(placed, "pos").select("grp", "block", "total", "leaf").mapInArrow(tidied(_build), BLOCKS))
        tiers.append(blocks)
        if most <= size:
            return tiers
        most = -(-most // size)
        rows = blocks.where(F.col("total") > size).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("leaf")
        )


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(grp, root): of each group the root of the one block above all its rows."""
    top = [t.where(F.col("total") <= ARITY**HEIGHT).select("grp", "root") for t in tiers]
    out = top[0]
    for t in top[1:]:
        out = out.unionByName(t)
    return out


def _walk(batches: Iterator[pa.RecordBatch], extra: list[str], schema: pa.Schema, told) -> Iterator[pa.RecordBatch]:
    """A block's row (pos -1), then its leaves -> ``told`` (grp, pos, path to the root, subroot, extra values) of each leaf."""
    nodes = above = subroot = None
    leaves = height = first = 0
    for batch in batches:
        out = []
        names = ("grp", "pos", "block", "total", "nodes", "above", "subroot", *extra)
        for grp, pos, block, total, n, a, s, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if pos < 0:
                nodes, above, subroot, height = n, a, s, height_of(total)
                first = block * ARITY**HEIGHT
                leaves = min(total - first, ARITY**HEIGHT)
                continue
            path = siblings(nodes, leaves, height, pos - first) + above
            out.append(told(grp, pos, path, subroot, *rest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _under(leaves: DataFrame, blocks: DataFrame, extra: list[str]) -> DataFrame:
    """Each block (with ``above`` and ``subroot``) in front of its leaves, dealt by block."""
    size = ARITY**HEIGHT
    heads = blocks.select("grp", F.lit(-1).cast("long").alias("pos"), "block", "total", "nodes", "above", "subroot")
    members = leaves.select("grp", "pos", F.floor(F.col("pos") / size).cast("long").alias("block"), *extra)
    return dealt(heads.unionByName(members, allowMissingColumns=True), "pos")


def _headed(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first tier's blocks with the path from their root to the root of all, and their group's root.

    ``above`` (grp, above, subroot) has the path from a group's root upwards.
    """
    size, kind = ARITY**HEIGHT, pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("above", pa.binary()), ("subroot", pa.binary())])
    paths = None
    for k in range(len(tiers) - 1, -1, -1):
        top = tiers[k].where(F.col("total") <= size).join(above, "grp")
        if paths is not None:
            rest = tiers[k].where(F.col("total") > size)
            top = top.unionByName(rest.join(paths.withColumnRenamed("pos", "block"), ["grp", "block"]))
        if k:
            leaves = tiers[k - 1].where(F.col("total") > size).select("grp", F.col("block").alias("pos"))
            met = _under(leaves, top, [])
            told = lambda grp, pos, path, subroot: (grp, pos, path, subroot)
            paths = met.mapInArrow(tidied(lambda b: _walk(b, [], kind, told)), PATHS)
    return top


class Manifest:
    """The trees of a table's groups, and the tree over their roots.

    ``rows`` has group (string, may be null), key, leaf (binary, 32 bytes) and any other columns. Leaves stand by key
    within their group, rows without a key last, rows that repeat a key by leaf; groups by their UTF-8 bytes, null first.
    Every ``ARITY`` consecutive nodes give the next level (the last run may have fewer, even one) until one node remains;
    a lone leaf is its group's root. The roots of the groups give the root of all in the same way.

    Tiers of blocks are checkpointed; a task holds one block of at most ``ARITY ** HEIGHT`` leaves at a time, however
    large the group. ``root`` is None for an empty table.
    """

    ALL = ""

    def __init__(self, rows: DataFrame, group: str = "source", key: str = "doc_id"):
        kept = [c for c in rows.columns if c not in (group, key, "leaf")]
        # a null group sorts first and is no other group's name
        grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
        self.extra = kept
        leaves = rows.select(grp.alias("grp"), F.col(f"`{key}`").alias("_key"), "leaf", *(F.col(f"`{c}`") for c in kept))
        self.rows = cut_lineage(positions(leaves, [F.col("_key").asc_nulls_last(), F.col("leaf")]))
        self.key = key
        self.tiers = build(self.rows)
        subroots = roots(self.tiers).select(F.lit(self.ALL).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf"))
        self.groups = cut_lineage(positions(subroots, [F.col("name")]))
        self.over = build(self.groups)
        found = roots(self.over).select("root").take(1)
        self.root = bytes(found[0]["root"]) if found else None

    def _above(self) -> DataFrame:
        """(grp, above, subroot) of every group."""
        start = self.groups.sparkSession.createDataFrame([(self.ALL, b"", b"")], "grp string, above binary, subroot binary")
        kind = pa.schema([("grp", pa.string()), ("above", pa.binary()), ("subroot", pa.binary())])
        told = lambda grp, pos, path, subroot, name, leaf: (name, path, leaf)
        met = _under(self.groups, _headed(self.over, start), ["name", "leaf"])
        return met.mapInArrow(tidied(lambda b: _walk(b, ["name", "leaf"], kind, told)), "grp string, above binary, subroot binary")

    def proofs(self, claim: str = "leaf") -> DataFrame:
        """Every row with its leaf, the digest of its siblings on the way to the root, the roots, and ``folded``: the root
        that its siblings and the digest of the column ``claim`` give. All digests are hex text."""
        claimed = [] if claim == "leaf" else [claim]
        extra = ["_key", "leaf", *claimed]
        key = self.rows.schema["_key"].dataType
        wanted = f"`{self.key}` {key.simpleString()}, leaf string, subroot string, proof_sha256 string, folded string"
        kind = pa.schema([(self.key, _arrow(key)), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded"))])

        def told(grp, pos, path, subroot, key, leaf, claim=None):
            return key, leaf.hex(), subroot.hex(), path_digest(path), fold(leaf if claim is None else claim, path).hex()

        met = _under(self.rows, _headed(self.tiers, self._above()), extra)
        out = met.mapInArrow(tidied(lambda b: _walk(b, extra, kind, told)), wanted)
        return out.withColumn("root", F.lit(self.root.hex() if self.root else None))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
