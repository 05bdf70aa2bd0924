import numpy as np
from pyspark.sql import functions as F

from provspark.llm.langid import UNKNOWN, Model, _calibrate, predict, train
from provspark.llm.langid_query import identified, op4


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op4(spark, sf).join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nulls_no_letters_repeats_and_empty(spark):
    words = {"aa": "bana bona buna banabo ", "bb": "kirx korx kurx korxi "}
    rows = [(i, words[k] * (1 + i % 4), k) for i, k in enumerate(["aa", "bb"] * 60)]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "123 !? 45", "aa"), (503, words["aa"], None), (503, words["aa"], None),
           (None, words["bb"], "bb"), (504, words["bb"] * 20000, None), (505, "z", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = identified(df).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == UNKNOWN and by_id[i]["rejected"] for i in (500, 501, 502))
    assert by_id[503]["lang_pred"] == "aa" and by_id[504]["lang_pred"] == "bb" and by_id[None]["lang_pred"] == "bb"
    assert sum(r["doc_id"] == 503 for r in got) == 2 and by_id[None]["held_out"] is False
    assert 0 <= by_id[505]["score"] <= 1
    assert identified(df.limit(0)).collect() == []


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, "alpha beta gamma " * 3, "aa") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    poisoned = df.withColumn("lang", F.when(crc == 1, "wrong").otherwise(F.col("lang")))
    assert {r["lang_pred"] for r in identified(poisoned).collect()} == {"aa"}


def test_calibration_finds_the_least_score():
    logits = np.array([[4.0, 0], [3, 0], [0.2, 0], [0.1, 0]])
    _, least = _calibrate(logits, np.array([0, 0, 1, 1]), 0.99)
    p = predict_scores(logits)
    assert p[2] < least


def predict_scores(logits):
    e = np.exp(logits)
    return (e / e.sum(axis=1, keepdims=True)).max(axis=1)


def test_model_without_languages(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    model = train(df, F.lit(0.0))
    assert isinstance(model, Model) and predict(df, model).first()["lang_pred"] == UNKNOWN
