import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm import topk
from provspark.llm.topk import top_k
from provspark.llm.topk_query import SQL, op5


def plain(rows, is_query, k=5):
    x = {}
    for i, v in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        q = [int(np.floor(256 * c)) for c in v]
        x[i] = min(x.get(i, q), q)
    out = set()
    for i in (i for i in x if is_query(i)):
        scores = sorted((-sum(a * b for a, b in zip(x[i], x[j], strict=False)), j) for j in x if j != i)
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert {tuple(r) for r in op5(spark, sf).collect()} == set(con.execute(SQL).fetchall())


@pytest.mark.parametrize("block, bucket", [(4096, 256), (16, 4)])
def test_lengths_ties_and_odd_vectors(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(300 + i, (-np.abs(rng.normal(size=8))).tolist()) for i in range(10)]
    nan = float("nan")
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [nan] * 8), (404, [float("inf")] * 8), (405, [0.0] * 8),
             (None, [1.0] * 8), (406, [1.0, 2.0]), (3, rows[3][1]), (5, [0.0] * 8), (410, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "id": F.lit("x")})
    got = top_k(df, F.col("vec_id") % 5 == 0)
    assert {tuple(r) for r in got.collect()} == plain(rows, lambda i: i % 5 == 0)


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 256)}
    assert top_k(df.limit(0), F.lit(True)).collect() == []
    assert top_k(df, F.lit(False)).collect() == []


@pytest.mark.parametrize("scale", [100, 1 << 20, 1 << 24, 1 << 30])
def test_a_bucket_is_multiplied_once_for_all_queries(monkeypatch, scale):
    """Products in doubles, longs and integers of any size are exact, and their number does not follow the queries."""
    rng, calls = np.random.default_rng(2), []
    products = topk.Candidates._products
    monkeypatch.setattr(topk.Candidates, "_products", lambda self, *a: calls.append(1) or products(self, *a))
    x, ids = rng.integers(-scale, scale, (1000, 16)), np.arange(1000)
    block, asked = topk.Candidates(ids.tobytes(), x.tobytes(), 16), topk.Queries(ids[:90].tobytes(), x[:90].tobytes(), 16)
    block.search(asked, np.full(90, topk.NO_BOUND), 5)
    assert len(calls) <= -(-1000 // topk.BUCKET)
    scores = x[:90].astype(object) @ x.T.astype(object)
    for q in range(90):
        want = sorted((-scores[q, j], j) for j in range(1000) if j != q)[:5]
        assert sorted((-int(s), int(i)) for s, i in zip(asked.best[q], asked.best_ids[q], strict=True)) == want
