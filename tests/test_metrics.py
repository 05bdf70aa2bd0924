"""Thresholds and metrics on ties, empty tails and known answers."""

import numpy as np
import pandas as pd
import pytest

from provspark.operators import metrics as M
from provspark.operators import reports as P
from provspark.operators import thresholds as T


def table(spark, groups, detector="d"):
    rows = [(detector, g, float(s)) for g, scores in groups.items() for s in scores]
    return spark.createDataFrame(rows, "detector string, grp string, score double")


def bisect(groups, fpr):
    lo, hi = -1000.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if np.mean([np.mean(np.asarray(s) > mid) for s in groups]) > fpr:
            lo = mid
        else:
            hi = mid
    return hi


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_group_mean_threshold_equals_bisection(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"a": rng.normal(size=2000), "b": np.round(rng.normal(1, 2, 300), 1), "c": rng.integers(0, 9, 40)}
    df = table(spark, groups)
    targets = [0.2, 0.05, 0.01, 0.001]
    got = {r["target"]: r["threshold"] for r in T.threshold_group_mean(df, targets).collect()}
    for f in targets:
        assert got[f] == pytest.approx(bisect(groups.values(), f), abs=1e-6)
    assert sorted(got.values()) == [got[f] for f in targets]


def test_all_negatives_at_the_maximum(spark):
    """More negatives than the target share the top score: strict exceedance finds nothing, the curve a fraction."""
    neg = table(spark, {"h": [1.0] * 10 + [0.0] * 90})
    pos = table(spark, {"p": [1.0] * 50 + [0.5] * 50})
    (row,) = T.threshold_group_mean(neg, [0.01]).collect()
    assert row["threshold"] == 1.0
    assert M.exceed_rate(pos, T.threshold_group_mean(neg, [0.01]), ["grp"]).first()["rate"] == 0.0
    assert M.tpr_at_fpr(neg, pos, [0.01]).first()["tpr"] == pytest.approx(0.05)


def test_tpr_takes_the_top_of_a_vertical_stretch(spark):
    neg = table(spark, {"h": [3.0, 1.0]})
    pos = table(spark, {"p": [4.0, 2.0, 2.5, 0.5]})
    got = {r["target"]: r["tpr"] for r in M.tpr_at_fpr(neg, pos, [0.0, 0.5, 0.75]).collect()}
    assert got == {0.0: 0.25, 0.5: 0.75, 0.75: 0.875 - 0.125}


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(5)
    neg, pos = rng.integers(0, 20, 200), rng.integers(3, 25, 150)
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    got = M.auc_by_group(table(spark, {"n": neg}), table(spark, {"p": pos})).first()
    assert got["auc"] == pytest.approx(want) and (got["n_neg"], got["n_pos"]) == (200, 150)
    flipped = M.auc_by_group(table(spark, {"n": -neg}), table(spark, {"p": -pos})).first()
    assert flipped["auc"] == pytest.approx(1 - want)


def test_kth_threshold_rounds_half_even(spark):
    df = table(spark, {"h": list(range(10))})
    row = T.threshold_kth(df, 0.25).first()  # 2.5 rounds to 2
    assert (row["k"], row["threshold"]) == (2, 8.0)
    assert T.threshold_kth(df, 0.0001).first()["k"] == 1


def test_roc_bracket_on_many_rows(spark):
    rng = np.random.default_rng(9)
    neg = rng.normal(size=50000)
    row = T.roc_bracket(table(spark, {"h": neg}), [0.01]).first()
    assert row["edge"] == pytest.approx(np.sort(neg)[::-1][500])
    assert row["fpr_above"] <= 0.01 < row["fpr_at"]


def test_macro_mean_weighs_groups_equally(spark):
    rows = [("d", "k_gen", "a", 1.0), ("d", "k_gen", "b", 0.0), ("d", "k_kanal", "c", 0.8)]
    out = M.macro_mean(spark.createDataFrame(rows, "detector string, kind string, grp string, rate double"), "rate", ["k_gen", "k_kanal"])
    got = {r["grp"]: r["rate"] for r in out.collect()}
    assert got == pytest.approx({"mixed generators": 0.5, "mixed channels": 0.8, "mixed all": 0.6})


def test_spearman(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 300).astype(float), "y": rng.normal(size=300)})
    pdf["y"] += pdf["x"]
    want = pdf["x"].rank().corr(pdf["y"].rank())
    assert M.spearman(spark.createDataFrame(pdf), "x", "y").first()["rho"] == pytest.approx(want)


def test_calibrate_keeps_the_first_thresholds(spark):
    heads = spark.createDataFrame([("d", 3.0, 1.0, None, None)], "tag string, thr_1 double, thr_5 double, thr_1_prev double, thr_5_prev double")
    neg = table(spark, {"a": range(100), "b": range(100)})
    once = P.calibrate(heads, neg)
    twice = P.calibrate(once, neg).first()
    assert (twice["thr_1"], twice["thr_1_prev"], twice["thr_5_prev"]) == (98.0, 3.0, 1.0)


def test_verdict_of_missing_score(spark):
    df = spark.createDataFrame([(9.0,), (6.0,), (1.0,), (None,)], "score double")
    assert [r["v"] for r in df.select(P.verdict("score", 8.0, 5.0).alias("v")).collect()] == ["flagged", "suspicious", "clear", ""]
