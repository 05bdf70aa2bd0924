"""Centroid clustering in exact integers, with JVM expressions only: literal centroid arrays, no Python on executors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.session import cut_lineage

#: Scaled components of this size and more, and sums beyond a long, end the job: they are neither cut off nor wrapped.
LARGEST, NO_DISTANCE = 1 << 62, (1 << 63) - 1


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, an error from ``LARGEST`` on."""
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    wide = F.raise_error(F.lit("centroids: a scaled component does not fit in 62 bits")).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(scaled(c)) >= float(LARGEST), wide).otherwise(F.floor(scaled(c))))


def nearest(vector: str, centroids: Sequence[Sequence[int]]) -> Column:
    """struct(distance, cluster) of the centroid that is nearest to a column of longs; of equally near ones the one with
    the smaller number. A squared distance that does not fit in a long counts as ``NO_DISTANCE``.

    Centroids are literal arrays in the text of the expression: built value by value it takes seconds on the driver.
    """
    each = []
    for k, c in enumerate(centroids):
        to = ",".join(f"{int(x)}L" for x in c)
        gap = f"zip_with({vector}, array({to}), (x, y) -> try_subtract(x, y))"
        squares = f"aggregate({gap}, 0L, (total, d) -> try_add(total, try_multiply(d, d)))"
        each.append(f"named_struct('distance', coalesce({squares}, {NO_DISTANCE}L), 'cluster', {k})")
    return F.expr(f"array_min(array({', '.join(each)}))")


def starts(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of seed and id, in that order."""
    draw = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.where("id is not null").select(draw.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at floor(sum / count) of the vectors nearest to it; one without vectors stays."""
    dims = len(centroids[0])
    assigned = rows.select("v", nearest("v", centroids).alias("best"))
    assigned = assigned.select(*(F.col("v")[i].alias(f"x{i}") for i in range(dims)), "best.distance", "best.cluster")
    sums = assigned.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("far"), *(F.try_sum(f"x{i}").alias(f"x{i}") for i in range(dims))
    )
    out = [list(c) for c in centroids]
    for r in sums.collect():  # a row per centroid
        if r["far"] == NO_DISTANCE or any(r[f"x{i}"] is None for i in range(dims)):
            raise OverflowError("centroids: a distance or a sum of components does not fit in a long")
        out[r["cluster"]] = [r[f"x{i}"] // r["n"] for i in range(dims)]  # floor, also of negative sums
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:",
    id_col: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector, and the ``k`` centroids after ``rounds`` rounds.

    Components become floor(scale * x). The first centroids are the vectors with the smallest sha256 of seed and id (rows
    that share an id: the lesser vector first; fewer vectors than ``k`` give as many centroids). A round assigns every
    vector to its nearest centroid by squared distance, ties to the smaller number, and moves each centroid to the floor
    of its vectors' mean; one without vectors stays. Then all are assigned once more.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Rows without an id are
    assigned and count, but never start a centroid; repeated rows count each. An empty table gives no rows and no
    centroids. Numbers that do not fit in a long are an error, never wrapped.

    A round reads the two columns anew and shuffles one row of sums per task and centroid, so that no group of vectors is
    gathered however large a cluster is; k rows come to the driver and go out as literals of the next round's plan.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v"), dims))
    rows = rows.select("id", integers(F.col("v"), scale).alias("v"))
    centroids = starts(rows, k, seed)
    if not centroids:  # no vector, or none with an id
        none = rows.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return none.withColumnRenamed("id", id_col), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    best = rows.select("id", nearest("v", centroids).alias("best")).select("id", "best.cluster", "best.distance")
    too_far = F.raise_error(F.lit("centroids: a distance does not fit in a long")).cast("long")
    checked = F.when(F.col("distance") == NO_DISTANCE, too_far).otherwise(F.col("distance"))
    return best.select(F.col("id").alias(id_col), "cluster", checked.alias("distance")), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with the sum of distances of its cluster (``cluster_inertia``) and of all (``inertia``), and the sha256
    of its centroid's components as decimal integers joined by commas (``centroid_sha256``)."""
    assigned = cut_lineage(assigned)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    if any(s is None for c, s in sums.items() if c is not None) or sum(s or 0 for s in sums.values()) > NO_DISTANCE:
        raise OverflowError("centroids: a sum of distances does not fit in a long")
    at = F.col("cluster") + 1
    own = F.array(*[F.lit(sums.get(k, 0)).cast("long") for k in range(len(centroids))] or [F.lit(None).cast("long")])
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    digest = F.array(*[F.lit(x) for x in named] or [F.lit(None).cast("string")])
    total = F.when(F.col("cluster").isNotNull(), F.lit(sum(s or 0 for s in sums.values())).cast("long"))
    return assigned.select(
        "*", F.try_element_at(own, at).alias("cluster_inertia"), total.alias("inertia"),
        F.try_element_at(digest, at).alias("centroid_sha256"),
    )
