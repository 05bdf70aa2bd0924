"""Radix select against numpy: edges of doubles, ties, hot and null keys, group weights."""

import math
import struct

import numpy as np
import pandas as pd
import pytest

from provspark.operators import radix as R
from provspark.operators import thresholds as T
from provspark.operators.ranks import exact_quantiles
from pyspark.sql import functions as F

EDGES = [
    0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-300, 0.1, 0.5, 0.9999999999999999, 1.0,
    1.0000000000000002, 2.0, 3.0, 7.999999999999999, 8.0, 1e15, 2.0**52, 2.0**53 - 1, 1e300, 1.7976931348623157e308, float("inf"),
]


def test_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(1)
    drawn = np.frombuffer(rng.bytes(8 * 4000), dtype="<f8")
    powers = [s * 2.0**e for e in range(-1074, 1024) for s in (1.0, 1 - 2**-53)]
    values = [v for v in [*EDGES, *powers, *map(abs, drawn.tolist())] if v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", R.ordered_bits(F.col("x")).alias("b"), R.ordered_bits(-F.col("x")).alias("m")).collect():
        want = struct.unpack("<q", struct.pack("<d", row["x"]))[0]
        assert (row["b"], row["m"]) == (want, -want), row["x"]
    odd = spark.createDataFrame([(-0.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in odd.select(R.ordered_bits(F.col("x"))).collect()] == [0, R.NAN, None]


@pytest.mark.parametrize("size", [1, 5, 4000])
def test_every_position(spark, size):
    """-0.0 ties with 0.0, NaN comes last, nulls are no rows; a null key is a key."""
    rng = np.random.default_rng(size)
    x = rng.choice(np.array([*EDGES, *[-e for e in EDGES], float("nan"), *rng.normal(size=30)]), size)
    k = rng.choice(np.array(["hot", "hot", "hot", "cold", None], dtype=object), size)
    rows = [(a, float(b)) for a, b in zip(k, x)] + [("hot", None), ("nulls only", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = R.select_ranks(df, ["k"], "x", F.array(F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1, F.col("n"))).collect()
    for key in {a for a in k}:
        mine = np.sort(x[[a == key for a in k]] + 0.0)
        found = {r["i"]: r for r in got if r["k"] == key}
        assert sorted(found) == [0, 1, 2]  # a position beyond the rows gives none
        for i, at in enumerate([0, len(mine) // 2, len(mine) - 1]):
            same = np.isnan(mine) if np.isnan(mine[at]) else mine == mine[at]
            want = (len(mine), at, int(np.argmax(same)), int(same.sum()))
            assert (found[i]["n"], found[i]["rank"], found[i]["below"], found[i]["peers"]) == want
            assert found[i]["value"] == mine[at] or math.isnan(found[i]["value"]) and np.isnan(mine[at])
            assert math.copysign(1, found[i]["value"]) == 1 or found[i]["value"] < 0
    assert not [r for r in got if r["k"] == "nulls only"]


def test_counts_stand_for_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 6)], "x double, times bigint")
    got = R.select_ranks(df, [], "x", F.array(F.lit(2), F.lit(3), F.lit(4))).collect()
    assert {r["i"]: (r["n"], r["value"], r["below"], r["peers"]) for r in got} == {
        0: (10, 1.0, 0, 3), 1: (10, 2.0, 3, 1), 2: (10, 5.0, 4, 6)
    }


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert R.select_ranks(df, ["k"], "x", F.array(F.lit(0))).count() == 0
    assert exact_quantiles(df, [], "x", [0.5]).first().asDict() == {"n": 0, "q0": None}
    assert exact_quantiles(df, ["k"], "x", [0.5]).count() == 0
    none = spark.createDataFrame([], "detector string, grp string, score double")
    assert T.threshold_group_mean(none, [0.01]).count() == 0 and T.roc_bracket(none, [0.01]).count() == 0


def test_infinite_quantiles(spark):
    df = spark.createDataFrame([(float("inf"),)] * 3 + [(1.0,)], "x double")
    assert exact_quantiles(df, [], "x", [0.0, 1.0]).first()["q1"] == float("inf")


def test_group_means_of_many_detectors(spark):
    """All targets and detectors at once; a row without a score counts in its group, and a null group is a group."""
    rng = np.random.default_rng(4)
    frames = []
    for d, n in (("a", 20000), ("b", 60), ("c", 1)):
        g = rng.choice(np.array(["x", "y", None], dtype=object), n, p=[0.8, 0.1, 0.1])
        s = np.round(rng.normal(size=n), 1 if d == "b" else 9)
        frames.append(pd.DataFrame({"detector": d, "grp": g, "score": [None if rng.random() < 0.05 else float(v) for v in s]}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "detector string, grp string, score double")
    targets = [0.5, 0.05, 0.001]
    got = {(r["detector"], r["target"]): r["threshold"] for r in T.threshold_group_mean(df, targets).collect()}
    for d, mine in pdf.groupby("detector"):
        seen = np.unique(mine["score"].dropna().astype(float))
        if not len(seen):
            continue
        groups = [v["score"].astype(float).to_numpy() for _, v in mine.groupby("grp", dropna=False)]
        above = np.mean([[(v > t).mean() for t in seen] for v in groups], axis=0)
        for f in targets:
            assert got[(d, f)] == seen[above <= f + 1e-12].min()


def test_one_settled_table_whatever_the_targets(spark, monkeypatch):
    """Passes do not grow with targets, keys or rows, and no sketch is taken."""
    made = []
    monkeypatch.setattr(R, "settle", lambda df: made.append(df) or df)
    for n, wanted in ((10, 1), (50000, 40)):
        made.clear()
        df = spark.range(n).select((F.col("id") % 7).alias("k"), F.rand(3).alias("x"))
        out = R.select_ranks(df, ["k"], "x", F.array(*[F.lit(i) for i in range(wanted)]))
        assert len(made) == 1
        assert "percentile" not in out._jdf.queryExecution().toString()
