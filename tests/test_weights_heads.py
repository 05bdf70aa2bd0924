"""Weights, heads and probes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provspark.operators import boosting as B
from provspark.operators import features as E
from provspark.operators import heads as K
from provspark.operators import weights as W
from provspark.operators.metrics import auc_two_sided
from provspark.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 500
    label = (rng.random(n) < 0.3).astype(int)
    source = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"item_id": np.arange(n), "label": label, "source": source, "rating": rng.integers(-1, 4, n)})
    return spark.createDataFrame(pdf)


def test_balanced_weights(rows):
    for mode in ("class", "source", "both"):
        pdf = W.balanced_weights(rows, mode).toPandas()
        assert pdf["w"].mean() == pytest.approx(1.0)
        if mode != "source":
            mass = pdf.groupby("label")["w"].sum()
            assert mass[0] == pytest.approx(mass[1])
        if mode != "class":
            shares = pdf.groupby((["label"] if mode == "both" else []) + ["source"])["w"].sum()
            for _, part in shares.groupby(level=0) if mode == "both" else [(0, shares)]:
                assert part.std() == pytest.approx(0.0, abs=1e-6)


def test_equalised_covariate(rows):
    pdf = W.equalise_covariate(W.balanced_weights(rows, "both"), "rating").toPandas()
    known = pdf[pdf["rating"] >= 0]
    share = known.groupby(["label", "rating"])["w"].sum() / known.groupby("label")["w"].sum()
    assert np.allclose(share[0], share[1]) and pdf["w"].mean() == pytest.approx(1.0)


def test_mlp_heads_match_numpy(spark):
    rng = np.random.default_rng(0)
    heads = [
        {"kind": "mlp", "mean": rng.normal(size=4), "scale": np.full(4, 2.0), "w1": rng.normal(size=(3, 4)), "b1": rng.normal(size=3),
         "w2": rng.normal(size=(1, 3)), "b2": rng.normal(size=1)}
        for _ in range(2)
    ]
    linear = {"kind": "logistic", "mean": [0.0] * 4, "scale": [1.0] * 4, "coef": [1.0, 2.0, 3.0, 4.0], "intercept": 0.5}
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame(pd.DataFrame({"i": range(20), "vec": [v.tolist() for v in x]}))
    got = K.score_heads(df, [*heads, linear]).toPandas().sort_values("i")["score"]
    want = x @ np.array(linear["coef"]) + 0.5
    for h in heads:
        z = ((x - h["mean"]) / h["scale"]) @ h["w1"].T + h["b1"]
        z = np.vectorize(lambda u: 0.5 * u * (1 + math.erf(u / math.sqrt(2))))(z)
        want = want + (z @ h["w2"].T + h["b2"])[:, 0]
    assert np.allclose(got, want / 3)


def test_training_finds_the_signal_and_bootstrap_is_poisson(spark):
    rng = np.random.default_rng(1)
    n = 400
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) + y[:, None] * [2.0, 0.0, 0.0]
    split = np.where(np.arange(n) < 250, "train", "val")
    df = spark.createDataFrame(
        pd.DataFrame({"item_id": np.arange(n), "label": y, "vec": [v.tolist() for v in x], "w": 1.0, "split": split})
    )
    model, grid = K.train_logistic(df.where("split = 'train'"), df.where("split = 'val'"), grid=[0.1, 10.0])
    assert grid.count() == 2 and auc_two_sided(K.apply_logistic(df.where("split = 'val'"), model), []).first()["auc"] > 0.85
    draws = spark.range(20000).select(K.poisson_weight(3, F.col("id")).alias("k")).toPandas()["k"]
    assert draws.mean() == pytest.approx(1.0, abs=0.03) and draws.var() == pytest.approx(1.0, abs=0.06)


def test_ensemble_stops_at_the_first_gap(spark):
    heads = spark.createDataFrame(
        [("t", s, [1.0], [1.0]) for s in (0, 1, 3)] + [("u", 0, [1.0], [2.0])], "tag string, seed int, mean array<double>, coef array<double>"
    )
    assert [r["seed"] for r in tables.load_ensemble(heads, "t").orderBy("seed").collect()] == [0, 1]
    out = tables.export_heads(heads, "t").collect()
    assert len(out) == 2 and all(len(r["sha256"]) == 64 and r["input_dim"] == 1 for r in out)
    assert sorted(r["seed"] for r in tables.merge_ensembles(heads, ["u", "t"], "new").collect()) == [0, 1, 2, 3]


def test_alignment_drops_items_missing_in_one_backbone(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "item_id int, vec array<float>")
    b = spark.createDataFrame([(2, [3.0]), (3, [4.0])], "item_id int, vec array<float>")
    assert [tuple(r) for r in E.align_features({"a": a, "b": b}).collect()] == [(2, [2.0, 3.0])]


def test_boosting_fits_counts_and_finds_what_leaks():
    rng = np.random.default_rng(2)
    bins = np.array([(a, b, c) for a in range(12) for b in range(12) for c in range(4)])
    odds = np.where((bins[:, 0] > 5) ^ (bins[:, 1] > 7), 2.0, -2.0)  # no single column tells
    n = rng.integers(0, 40, len(bins))
    hit = rng.binomial(n, 1 / (1 + np.exp(-odds)))
    score = B.boosted_scores(bins, n - hit, hit)
    assert np.corrcoef(score, odds)[0, 1] > 0.95 and abs(np.abs(score[n > 0]).mean() - 2) < 0.5
    assert (B.boosted_scores(bins, n - hit, hit) == score).all()  # the same on every run
    # a whole table and its counts are the same thing
    rows = np.repeat(np.arange(len(bins)), n)
    assert np.isfinite(B.boosted_scores(bins[rows], np.ones(len(rows), int), np.zeros(len(rows), int), trees=5)).all()


def test_leak_probe_judges_every_row(spark):
    rng = np.random.default_rng(3)
    n = 3000
    label = rng.integers(0, 2, n)
    leak = np.where(rng.random(n) < 0.9, label, 1 - label) * 100.0 + rng.normal(size=n)
    df = pd.DataFrame({"label": label, "model": np.where(label == 1, [f"m{i % 2}" for i in range(n)], "human"), "leak": leak,
                       "noise": rng.normal(size=n), "split": np.where(rng.random(n) < 0.5, "train", "test")})
    df.loc[::17, "leak"] = None
    spark_df = spark.createDataFrame(df.astype({"leak": "object"}).where(df.notna(), None), "label int, model string, leak double, noise double, split string")
    got = {(r["variant"], r["grp"]): r for r in K.leak_probes(spark_df, {"raw": ["leak", "noise"], "clean": ["noise"]}, "model", trees=60).collect()}
    test = df[df["split"] == "test"]
    assert set(got) == {(v, g) for v in ("raw", "clean") for g in ("all", "m0", "m1")}
    assert all(r["n_neg"] == (test["label"] == 0).sum() for r in got.values()) and got["raw", "all"]["n_pos"] == (test["label"] == 1).sum()
    assert got["raw", "all"]["auc"] > 0.8 and abs(got["clean", "all"]["auc"] - 0.5) < 0.06
    with pytest.raises(ValueError):
        B.bin_edges(spark_df, [f"c{i}" for i in range(30)])


def test_vectors_of_another_length_are_an_error(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "item_id int, text string")
    assert E.extract_features(df, "text", E.trigram_model(8), 8).count() == 1
    with pytest.raises(Exception, match="no vector of 9"):
        E.extract_features(df, "text", E.trigram_model(8), 9).collect()


def test_auc_of_counted_rows(spark):
    rows = [(1.0, 0, 3), (1.0, 1, 1), (2.0, 1, 5), (0.0, 0, 2), (0.0, 1, 4)]
    counted = spark.createDataFrame(rows, "score double, label int, times long")
    single = counted.selectExpr("score", "label", "explode(sequence(1, times)) as _i").drop("_i")
    assert auc_two_sided(counted, []).collect() == auc_two_sided(single, []).collect()


def test_stack_counts_items_of_equal_scores_and_those_left_out(spark):
    kinds = ("m_val", "m_test", "k_gen", "k_kanal")
    rows = [(i, kinds[i % 4], d, float((i * 7) % 10 + (i % 4 > 1) * 4) / (2 if d == "b" else 1)) for i in range(240) for d in "ab" if (i, d) != (5, "b")]
    got = {r["combination"]: r for r in K.stack(spark.createDataFrame(rows, "item_id long, kind string, detector string, score double"), "a", ["b"], 0.2).collect()}
    a = pd.DataFrame([r for r in rows if r[2] == "a" and r[0] != 5], columns=["i", "kind", "d", "s"]).groupby("kind")["s"].apply(np.array)
    cut = np.quantile(a["m_val"], 0.8)
    assert got["a"]["fpr"] == pytest.approx((a["m_test"] > cut).mean()) and got["a"]["hit"] == pytest.approx((a["k_kanal"] > cut).mean())
    beats = (a["k_kanal"][:, None] > a["m_test"][None]) + 0.5 * (a["k_kanal"][:, None] == a["m_test"][None])
    assert got["a"]["auc"] == pytest.approx(beats.mean()) and {r["left_out"] for r in got.values()} == {1} and set(got) == {"a", "b", "a + b"}


BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def test_extracted_texts_come_in_bounded_batches(spark):
    for key in BATCHES:
        spark.conf.unset(key)
    E.extract_features(spark.createDataFrame([(1, "abc")], "item_id long, text string"), "text", E.trigram_model(64), 64)
    assert all(int(spark.conf.get(key)) <= most for key, most in BATCHES.items())
