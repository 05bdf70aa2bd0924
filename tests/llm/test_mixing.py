import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm.mixing import BINS, FEATURES, copies, features, fit, fit_rates, mix, posteriors
from provspark.llm.mixing_query import domains, op2


def plain_rates(tokens, p, weights, budget, lowest, highest, rounds=60, tolerance=1e-4):
    r = np.full(len(tokens), min(max(1.0, lowest), highest))
    step = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p / budget).max()
    for _ in range(rounds):
        gap = ((tokens * r) @ p - np.array(weights) * budget) / budget
        if abs(gap).max() < tolerance:
            break
        r = np.clip(r - step * (p @ gap), lowest, highest)
    return r


@pytest.mark.parametrize("lowest, highest, weights", [(0, 4, [0.5, 0.3, 0.2]), (1, 4, [0.2, 0.2, 0.6]), (0, 1, [0.1, 0.1, 0.8])])
def test_rates_equal_a_plain_descent(spark, lowest, highest, weights):
    rng = np.random.default_rng(2)
    tokens, p = rng.integers(0, 900, 300), rng.dirichlet([0.4, 0.4, 0.4], 300)
    rows = [(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    budget = float(tokens.sum())
    got = {r["doc_id"]: r["rate"] for r in fit_rates(df, weights, budget, lowest, highest).collect()}
    want = plain_rates(tokens, p, weights, budget, lowest, highest)
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6
    if lowest == 0 and highest == 4:
        totals = (tokens * want) @ p
        assert abs(totals / budget - weights).max() < 2e-3


def test_a_small_domain_beside_a_hot_one_meets_its_target(spark):
    kind = np.repeat([0, 1, 2], [900, 90, 10])
    rows = [(i, 50 + i % 100, [float(k == j) for j in range(3)]) for i, k in enumerate(kind)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    budget = float(sum(t for _, t, _ in rows))
    rated, gap = fit(df, [0.9, 0.07, 0.03], budget)
    totals = np.zeros(3)
    for r in rated.collect():
        totals += r["tokens"] * r["rate"] * np.array(r["p"])
    assert abs(totals / budget - [0.9, 0.07, 0.03]).max() < 2e-4
    assert np.allclose(totals / budget - [0.9, 0.07, 0.03], gap, atol=1e-6)


def test_posteriors_equal_plain_counts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = features(docs)
    got = {r["doc_id"]: r for r in posteriors(rows, domains(labels), ["good", "poor"]).collect()}
    bins = {r["doc_id"]: r for r in rows.collect()}
    counts = np.full((2, FEATURES, BINS), 0.5)
    for r in labels.collect():
        if r["quality"] in (0, 1) and r["doc_id"] in bins:
            for f, b in enumerate(bins[r["doc_id"]]["bins"]):
                counts[0 if r["quality"] == 1 else 1, f, b] += 1
    prior = counts[:, 0].sum(axis=1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    for i, r in bins.items():
        s = np.log(prior / prior.sum()) + logs[:, range(FEATURES), r["bins"]].sum(axis=1)
        e = np.exp(s - s.max())
        assert np.allclose(got[i]["p"], e / e.sum())


def test_labelled_domains_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([(r["p"][0] > 0.5) == (r["quality"] == 1) for r in rows]) > 0.9


def test_nulls_empty_long_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, "w " * 200000), (4, "A B C"), (4, "A B C"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p": F.lit(1), "tokens": F.lit("t"), "bins": F.lit(0)})
    labels = spark.createDataFrame([(4, None), (9, "good"), (None, "poor")], "doc_id long, domain string")
    got = mix(df, labels, {"good": 1.0, "poor": 1.0}).collect()
    assert len(got) == 6 and all(abs(sum(r["p"]) - 1) < 1e-9 and 0 <= r["rate"] <= 4 for r in got)
    assert {r["doc_id"]: r["tokens"] for r in got} == {1: 0, 2: 0, 3: 200000, 4: 3, None: 2}
    assert mix(df.limit(0), labels, {"good": 1.0, "poor": 1.0}).collect() == []


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(4000).withColumn("n", copies(F.col("id"), F.lit(1.3)))
    counts = {r["n"]: r["count"] for r in df.groupBy("n").count().collect()}
    assert set(counts) == {1, 2} and abs(counts[2] / 4000 - 0.3) < 0.03
