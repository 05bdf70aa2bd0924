"""Scans, ranks and quantiles against pandas, with hot keys and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provspark.operators import ranks as R
from provspark.operators.scan import row_index, scan, split_points


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n)),
            "o": rng.permutation(n),
            "v": rng.integers(0, 50, n).astype(float),
            "t": np.where(rng.random(n) < 0.3, [f"t{i}" for i in range(n)], None),
        }
    )


def test_split_points_are_bounded(spark, frame):
    points = split_points(spark.createDataFrame(frame), "o", 8)
    assert 1 <= len(points) <= 7 and points == sorted(set(points))


@pytest.mark.parametrize("descending", [False, True])
def test_scan_matches_pandas(spark, frame, descending):
    df = spark.createDataFrame(frame)
    out = scan(
        df, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("t"))}, descending=descending
    ).toPandas()
    want = frame.sort_values("o", ascending=not descending).copy()
    want["s"] = want.groupby("k")["v"].cumsum()
    want["m"] = want.groupby("k")["v"].cummax()
    want["l"] = want.groupby("k")["t"].ffill()
    a = out.sort_values("o").reset_index(drop=True)
    b = want.sort_values("o").reset_index(drop=True)
    assert np.allclose(a["s"], b["s"]) and np.allclose(a["m"], b["m"])
    assert a["l"].fillna("").tolist() == b["l"].fillna("").tolist()


def test_row_index_is_global(spark, frame):
    out = row_index(spark.createDataFrame(frame), "o").toPandas()
    assert (out["idx"] == out["o"]).all()


def test_average_ranks(spark, frame):
    out = R.average_ranks(spark.createDataFrame(frame), ["k"], "v").toPandas()
    frame = frame.assign(r=frame.groupby("k")["v"].rank())
    want = frame.groupby(["k", "v"])["r"].first()
    assert all(abs(want[(r.k, r.v)] - r.avg_rank) < 1e-9 for r in out.itertuples())


@pytest.mark.parametrize("size", [1, 2, 7, 3000, 60000])
def test_exact_quantiles(spark, size):
    rng = np.random.default_rng(size)
    x = np.where(rng.random(size) < 0.3, 1.0, rng.normal(size=size))
    g = np.where(rng.random(size) < 0.9, "hot", "cold")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    probs = [0.0, 0.5, 0.99, 1.0]
    whole = R.exact_quantiles(df, [], "x", probs).first()
    assert np.allclose([whole[f"q{i}"] for i in range(4)], np.quantile(x, probs))
    for row in R.exact_quantiles(df, ["g"], "x", probs).collect():
        assert np.allclose([row[f"q{i}"] for i in range(4)], np.quantile(x[g == row["g"]], probs))


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert R.exact_quantiles(df, [], "x", [0.5]).first()["q0"] == 2.0
