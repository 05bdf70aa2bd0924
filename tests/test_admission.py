"""Rules, quotas, splits and block lists on edge rows."""

import collections
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provspark.functions import hashing as H
from provspark.functions import text as X
from provspark.operators import admission as A
from provspark.operators import sampling as S
from provspark.operators import splits as L


@pytest.fixture(scope="module")
def arrivals(spark):
    rng = np.random.default_rng(1)
    n = 600
    users = np.where(rng.random(n) < 0.35, "hot", rng.choice([f"u{i}" for i in range(60)], n)).astype(object)
    users[rng.random(n) < 0.05] = None
    pdf = pd.DataFrame({"id": np.arange(n), "user": users, "ok": rng.random(n) < 0.5})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("stored_only", [False, True])
@pytest.mark.parametrize("with_prior", [False, True])
def test_quota_against_a_loop(spark, arrivals, stored_only, with_prior):
    pdf, df = arrivals
    prior = {"u1": 2, "u2": 5, "hot": 1} if with_prior else {}
    have, want = collections.Counter(prior), {}
    for r in pdf.itertuples():
        over = r.user is not None and have[r.user] >= 3
        want[r.id] = over
        if not over and (r.ok or not stored_only):
            have[r.user] += 1
    table = spark.createDataFrame(list(prior.items()), "user string, prior int") if prior else None
    out = S.quota(df, ["user"], "id", 3, counts=F.col("ok") if stored_only else None, prior=table)
    assert {r["id"]: r["over_quota"] for r in out.collect()} == want


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise("x"))
    first = S.first_n(df, ["k"], "id", 50, rank="place").where("k = 'hot'").orderBy("place").collect()
    assert [(r["id"], r["place"]) for r in first] == [(3 * i, i + 1) for i in range(50)]
    out = S.quota(df, ["k"], "id", 50)
    assert out.where("not over_quota").groupBy("k").count().select("count").distinct().collect()[0][0] == 50


def test_greedy_split_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(7)
    sizes = {f"g{i}": int(s) for i, s in enumerate(np.r_[rng.integers(1, 4, 150), [400, 90, 90, 17]])}
    rows = [(g,) for g, s in sizes.items() for _ in range(s)]
    got = {r["g"]: r["split"] for r in L.greedy_group_split(spark.createDataFrame(rows, "g string"), "g").collect()}
    shares, have, want = {"test": 3, "val": 2, "train": 15}, dict.fromkeys(("test", "val", "train"), 0), {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], zlib.crc32(g.encode()))):
        s = min(shares, key=lambda s: have[s] / shares[s])
        want[g] = s
        have[s] += sizes[g]
    assert got == want


def test_splits_never_divide_a_creator(spark):
    keys = spark.range(3000).select(F.concat(F.lit("web:"), (F.col("id") % 700).cast("string")).alias("k"))
    rows = keys.select("k", H.hash_split(F.col("k"), "web").alias("s")).distinct().collect()
    assert len(rows) == 700
    for r in rows:
        b = zlib.crc32(r["k"].encode()) % 20
        assert r["s"] == ("test" if b < 2 else "val" if b == 2 else "train")


def test_chrono_holdout_with_one_hot_day(spark):
    rng = np.random.default_rng(0)
    n = 400
    day = pd.to_datetime("2020-01-01") + pd.to_timedelta(np.where(rng.random(n) < 0.6, 50, rng.integers(0, 90, n)), "D")
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": np.where(rng.random(n) < 0.8, "a", "b"), "day": day.date})
    pdf.loc[:20, "day"] = None
    df = spark.createDataFrame(pdf, "id long, g string, day date")
    got = {r["id"]: r["split"] for r in S.chrono_holdout(df, ["g"], "day", "id").collect()}
    want = {}
    for _, part in pdf.groupby("g"):
        order = sorted(part.itertuples(), key=lambda r: (r.day is not None, str(r.day), r.id))
        cut = int(0.9 * len(order))
        want |= {r.id: "train" if i < cut else "val" for i, r in enumerate(order)}
    assert got == want


def test_first_rule_wins_and_null_conditions_do_not_hold(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, w int")
    rules = [("small", F.col("w") < 10), ("any", F.col("w") < 100)]
    assert [r["reason"] for r in A.admit(df, rules).orderBy("id").collect()] == [None, "small", "any"]


def test_tombstone_erases_and_probe_only_marks(spark):
    df = spark.createDataFrame(
        [(1, "a.jpg", "x", None), (2, "b.jpg", "y", "foto"), (3, "c.jpg", "z", None)], "id int, path string, tag string, reason string"
    )
    hits = spark.createDataFrame([(1,), (2,)], "id int")
    kept, removed = A.tombstone(df, hits, "id", [], "gesperrt")
    assert [tuple(r) for r in kept.orderBy("id").collect()] == [
        (1, None, None, "gesperrt"), (2, "b.jpg", "y", "foto"), (3, "c.jpg", "z", None)
    ]
    assert [r["path"] for r in removed.collect()] == ["a.jpg"]
    probe, _ = A.tombstone(df, hits, "id", [], "gesperrt", probe=True)
    assert {r["id"]: r["policy_hit"] for r in probe.collect()} == {1: True, 2: False, 3: False}
    assert probe.where("tag is null").count() == 0


def test_leave_out_must_match(spark):
    df = spark.createDataFrame([("s", "m", "d")], "source string, model string, detail string")
    with pytest.raises(ValueError):
        A.leave_out(df, ["other"])
    assert A.leave_out(df.union(spark.createDataFrame([("s", "n", None)], df.schema)), ["s:d"]).count() == 1


def test_retry_only_errors(spark):
    df = spark.range(4).withColumnRenamed("id", "k")
    decided = spark.createDataFrame([(0, "fehler: X"), (1, None), (2, "foto")], "k long, reason string")
    assert [r["k"] for r in A.only_new(df, decided, "k", True).orderBy("k").collect()] == [0, 3]


@pytest.mark.parametrize("rule", ["cascade", "words"])
def test_texts_come_to_the_rules_in_bounded_batches(spark, rule):
    batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
    for key in batches:
        spark.conf.unset(key)
    if rule == "words":
        X.policy_words(F.col("text"), ["bad"])
    else:
        A.admit_cascade(spark.createDataFrame([([], "t", 1, 1, 1, 0.1)], "tags array<string>, text string, rating int, w int, h int, real_score double"), "prompted", {})
    assert all(int(spark.conf.get(key)) <= most for key, most in batches.items())
