import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm.centroids import cluster, with_inertia
from provspark.llm.clusters_query import op13


def plain(rows, k, rounds, dims, scale=256, seed="2:"):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    best = [near(v) for _, v in kept]
    total = [sum(d for d, n in best if n == c) for c in range(len(cents))]
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, total[n], sum(total), hashed[n]) for (i, _), (d, n) in zip(kept, best, strict=True)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_a_whole_table(spark, sf):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows(op13(spark, sf)) == plain(data, 40, 5, 64)


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 7), (2, 60)])
def test_odd_vectors_ties_and_more_centroids_than_vectors(spark, seed, k):
    rng = random.Random(seed)
    data = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(40)]  # many ties, empty centroids
    data += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 0.0, 0.0]), (104, [math.nan] * 4), (105, [math.inf, 0.0, 0.0, 0.0]),
             (None, [0.5] * 4), (5, [0.1] * 4), (5, [0.1] * 4), (6, [-3.0] * 4), (200, [1e6, -1e6, 3.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    df = df.withColumn("cluster", F.lit("x")).withColumn("id", F.lit(1)).withColumn("v", F.lit(2))  # names of its own columns
    assert rows(with_inertia(*cluster(df, k, 4, 4))) == plain(data, k, 4, 4)


def test_empty_table_and_vectors_without_ids(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rows(with_inertia(*cluster(df))) == []
    df = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert rows(with_inertia(*cluster(df, 3, 2, 2))) == [(None, None, None, None, None, None)]


def test_numbers_beyond_a_long_are_an_error(spark):
    near = [(i, [1e7 + i, 0.0]) for i in range(3)]
    far = [(9, [-1e7, 0.0]), (10, [-1e7 - 2, 0.0])]  # squared distances of 2.6e19 between the groups, small ones within
    df = spark.createDataFrame(near + far, "vec_id long, embedding array<double>")
    assert rows(with_inertia(*cluster(df, 5, 2, 2))) == plain(near + far, 5, 2, 2)
    with pytest.raises(OverflowError):
        cluster(df, 1, 1, 2)
    with pytest.raises(Exception, match="62 bits"):
        cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 1, 1, 2)


def test_no_python_on_executors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assigned, cents = cluster(df, 3, 1)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(np.array(cents)) == 3
