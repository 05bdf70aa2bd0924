"""Duplicate groups: greedy leaders over similarity, connected components over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.similarity import collapse_copies, earlier_neighbours
from provspark.session import cut_lineage, cut_round, scratch


#: Earlier neighbours of a row that are kept at a time.
NEIGHBOURS = 32


def leader_clusters(df: DataFrame, at_least: float) -> DataFrame:
    """Greedy clustering in id order: a row joins the earliest leader within the limit, else it leads. (id, leader)

    One similarity join gives each row its earliest neighbours, ``NEIGHBOURS`` at most, so that the pairs of a large group
    are never emitted. Rounds over these lists alone decide the rest: followers leave the lists, a row follows the first
    of its list once that leads, and leads once its list is empty. Should a list run out whose row has further
    neighbours, such rows are joined again with all rows that are no followers. Rows without a vector stay alone.
    """
    vectors = df.where(F.col("vec").isNotNull())
    distinct, copies = collapse_copies(vectors, "vec")
    distinct = cut_lineage(distinct)
    alone = df.where(F.col("vec").isNull()).select("id", F.col("id").alias("leader"))
    rows = distinct.select("id", "vec")
    open_rows, decided = _listed(rows.select("id"), earlier_neighbours(rows, rows, at_least, NEIGHBOURS)), None
    path = scratch(df.sparkSession, "leaders")  # each round adds the rows that it decides
    while True:
        first = F.get("near", F.lit(0))
        leader = F.when(first["leads"], first["b"]).when(F.size("near") == 0, F.when(F.col("whole"), F.col("id")))
        stepped = cut_round(open_rows.withColumn("leader", leader))
        new = stepped.where("leader is not null").select("id", "leader")
        rest = stepped.where("leader is null").drop("leader")
        left = stepped.agg(F.count("*").alias("rows"), F.count("leader").alias("new")).first()
        if not left["rows"]:
            break
        if not left["new"]:
            # only lists that ran out are left to begin with
            out = rest.where((F.size("near") == 0) & ~F.col("whole")).select("id")
            followers = decided.where("id <> leader").select("id")
            more = earlier_neighbours(rows.join(out, "id"), rows.join(followers, "id", "left_anti"), at_least, NEIGHBOURS)
            again = _listed(out, more, decided)
            open_rows = cut_round(rest.join(out, "id", "left_anti").unionByName(again))
            continue
        new.write.mode("append").parquet(path)
        decided = df.sparkSession.read.schema(new.schema).parquet(path)
        told = new.select(F.col("id").alias("b"), (F.col("id") == F.col("leader")).alias("is_leader"))
        each = rest.select("id", "whole", F.explode_outer("near").alias("n")).select("id", "whole", "n.b", "n.leads")
        each = each.join(told, "b", "left").withColumn("leads", F.coalesce("leads", F.lit(False)) | F.coalesce("is_leader", F.lit(False)))
        kept = F.when(F.col("b").isNotNull() & F.coalesce("is_leader", F.lit(True)), F.struct("b", "leads"))
        open_rows = each.groupBy("id").agg(F.first("whole").alias("whole"), F.array_sort(F.collect_list(kept)).alias("near"))
        open_rows = open_rows.select("id", "near", "whole")
    if decided is None:
        return alone
    followed = decided.withColumnRenamed("id", "first")
    return copies.join(followed, "first").select("id", "leader").unionByName(alone)


def _listed(ids: DataFrame, near: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """(id, near: array of (b, leads), whole); rows without neighbours have an empty, whole list."""
    each = ids.join(near, "id", "left").select("id", F.coalesce("whole", F.lit(True)).alias("whole"), F.explode_outer("near").alias("b"))
    if decided is None:
        each = each.withColumn("leads", F.lit(False))
    else:
        leaders = decided.where("id = leader").select(F.col("id").alias("b"), F.lit(True).alias("leads"))
        each = each.join(leaders, "b", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    kept = F.when(F.col("b").isNotNull(), F.struct("b", "leads"))
    listed = each.groupBy("id").agg(F.first("whole").alias("whole"), F.array_sort(F.collect_list(kept)).alias("near"))
    return listed.select("id", "near", "whole")


def connected_groups(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (node, component); the component is its smallest node.

    Rounds of minimum-label exchange with pointer jumping. Every shuffle is an aggregation with map-side combine or a
    join against one row per node, so a node with very many edges is split by the skew join.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        lowered = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = cut_lineage(
            lowered.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label"))
        )
        if stepped.where("old <> label").isEmpty():
            return stepped.select("node", F.col("label").alias("component"))
        labels = stepped.select("node", "label")
