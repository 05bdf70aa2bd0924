import numpy as np
from pyspark.sql import functions as F

from provspark.llm.toxicity import CONTEXT_AT, LABEL_AT, VOTERS, LabelModel, Voters, votes_of
from provspark.llm.toxicity_query import op1, scored


def test_label_model_finds_accurate_and_repeated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.1
    votes = np.zeros((len(y), VOTERS))
    for k in range(4):
        votes[:, k] = rng.random(len(y)) < np.where(y, 0.8, 0.01)
    votes[:, 4] = votes[:, 3]  # a copy of another voter
    votes[:, 5] = rng.random(len(y)) < 0.2  # noise
    bits = (votes.astype(np.int64) << np.arange(VOTERS)).sum(axis=1)
    label = np.where(rng.random(len(y)) < 0.05, 1 + (y ^ (rng.random(len(y)) < 0.05)), 0)  # few known, some of them wrong
    pattern, count = np.unique(bits | label << LABEL_AT, return_counts=True)
    model = LabelModel.fit(pattern, count.astype(float))
    assert abs(model.prior - 0.1) < 0.03
    assert model.correlation[3, 4] > 0.9 and model.discount[3] < 0.7 < model.discount[0]
    assert (model.toxic[:4] > 0.6).all() and (model.clean[:4] < 0.05).all()
    assert abs(np.log(model.toxic[5] / model.clean[5])) < 0.5
    right = (model.posterior(bits) > 0.5) == y
    assert right.mean() > 0.97


def test_labels_anchor_voters_that_never_fire_together():
    """Two languages with voters of their own: one unanchored class would lock on the larger one."""
    rng = np.random.default_rng(1)
    y, other = rng.random(40000) < 0.1, rng.random(40000) < 0.2
    votes = np.zeros((len(y), VOTERS), bool)
    for k in range(6):
        votes[:, k] = ~other & (rng.random(len(y)) < np.where(y, 0.6, 0.001))
    votes[:, 11] = other & (rng.random(len(y)) < np.where(y, 0.9, 0.02))
    label = np.where(rng.random(len(y)) < 0.2, 1 + (y ^ (rng.random(len(y)) < 0.02)), 0)
    bits = (votes.astype(np.int64) << np.arange(VOTERS)).sum(axis=1) | np.where(other, 2, 1) << CONTEXT_AT
    pattern, count = np.unique(bits | label << LABEL_AT, return_counts=True)
    model = LabelModel.fit(pattern, count.astype(float))
    q = model.posterior(bits)  # without any label
    assert model.toxic[11] > 0.8 and model.clean[11] < 0.05 and not model.heard[1, 11] and model.heard[2, 11]
    assert (q[y & other] > 0.5).mean() > 0.85 and (q[y & ~other] > 0.5).mean() > 0.9 and (q[~y] > 0.5).mean() < 0.01


def test_patterns_do_not_reach_over_documents():
    raw, offsets = np.frombuffer(b"you are an" + b" idiot" + b"shut" + b" up" + b"shut up", np.uint8), np.array([0, 10, 16, 20, 23, 30])
    bits = votes_of(raw, offsets, Voters.of([], []).plain())
    assert (bits >> 6 & 7).tolist() == [0, 0, 0, 0, 2] and (bits & 1).tolist() == [0, 1, 0, 0, 0]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = op1(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert got.count() == 1000 and len(held) > 50
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) > 0.6  # six per cent of the labels are wrong
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.05


def test_recall_of_held_out_documents_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = rows.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.85
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.03
    for lang in {r["lang"] for r in rows}:
        assert np.mean([r["predicted"] for r in rows if r["toxic"] and r["lang"] == lang]) > 0.75, lang


def test_nulls_long_repeats_empty_and_no_labels(spark):
    clean = [(i, "the cat sat on a mat near door %d" % i) for i in range(60)]
    toxic = [(100 + i, "you are an idiot and a pathetic loser %d" % i) for i in range(30)]
    odd = [(500, None), (501, ""), (502, "word " * 200000 + "you are an idiot and a pathetic loser"), (503, "plain text"), (503, "plain text"),
           (None, "You are an IDIOT and a pathetic, pathetic loser!")]
    df = spark.createDataFrame(clean + toxic + odd, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (700, None), (501, 0)], "doc_id long, toxic int"
    )
    got = scored(df, labels).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 96 and sum(r["doc_id"] == 503 for r in got) == 2
    assert by_id[502]["predicted"] == 1 and by_id[None]["predicted"] == 1 and by_id[None]["held_out"] is False
    assert not any(by_id[i]["predicted"] for i in (500, 501, 503))
    assert all(by_id[i]["predicted"] for i, _ in toxic) and not any(by_id[i]["predicted"] for i, _ in clean)
    assert scored(df.limit(0), labels).collect() == []
    unlabelled = {r["doc_id"]: r["predicted"] for r in scored(df, labels.limit(0)).collect()}
    assert unlabelled[502] == 1 and unlabelled[503] == 0
