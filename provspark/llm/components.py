"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, component): the smallest node reachable. Nodes without an edge are not listed.

    Each round joins every node's larger neighbours, then all its smaller ones, to the smallest of its neighbourhood,
    until each edge points to its component; the number of rounds grows with the logarithm of the nodes. Neighbourhoods
    are never gathered: their least node is a map-side combined minimum, and a node with very many edges is split by
    the skew join. Null ends and loops are left out.
    """
    larger = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = _fixed(larger)
    while True:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.select(F.inline(ways)).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # larger neighbours (b > a) to the least of the neighbourhood
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # smaller neighbours to the least of them, and the node itself
        node = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(low, "a").select(node.alias("a"), F.col("m").alias("b"))
        edges, now = _fixed(small.where("a <> b"))
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now


def _fixed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges behind a checkpoint, and what tells them from those of another round: their number and the sums of
    two hashes, from one small job instead of a comparison row by row."""
    edges = cut_lineage(edges.distinct())
    sums = [F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(20,0)")) for k in range(2)]
    return edges, tuple(edges.agg(F.count("*"), *sums).first())
