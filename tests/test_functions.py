"""Scalar functions on literal rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from provspark.functions import numeric as N
from provspark.functions import text as X
from provspark.functions import vectors as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "version", "bucket"),
    [
        ("a cat --v 5.2", "v5.2", "v5"), ("x --niji 6 --v 4", "niji6", "niji"), ("x --testp", "testp", "test"),
        ("x --v test", "vtest", "vtest"), ("version midjourney: 4", "v4", "v4"), ("Midjourney v6.1 now", "v6.1", "v6"), ("plain", "", "none"),
    ],
)
def test_prompt_version(spark, text, version, bucket):
    assert one(spark, text, X.prompt_version) == version
    assert one(spark, text, lambda c: X.version_bucket(X.prompt_version(c))) == bucket


def test_file_names(spark):
    name = "photo_12@03-02-2021_10-11-12_1920x1080.jpg"
    assert str(one(spark, name, X.file_date)) == "2021-02-03"
    assert one(spark, name, X.parse_resolution) == 1920
    assert one(spark, "plain.jpg", X.file_date) is None and one(spark, "plain.jpg", X.parse_resolution) == 0
    assert one(spark, "p@31-02-2021.jpg", X.file_date) is None
    assert one(spark, "a/b/77.png", X.numeric_stem) == 77 and one(spark, "a/b7.png", X.numeric_stem) is None


def test_earliest_year(spark):
    raw = 'CreateDate="2031-01 DateTimeOriginal>2011 2009:05:06 07:08:09 1990:05:06 07:08:09'
    assert one(spark, raw, X.earliest_year) == 2009
    assert one(spark, "nothing", X.earliest_year) is None


def test_many_overlapping_terms_in_one_pass(spark):
    import random

    rng = random.Random(0)
    terms = sorted({"".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9))) for _ in range(120_000)})[:100_000]
    texts = ["".join(rng.choice("abcdé #_") for _ in range(60)) for _ in range(20)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    found = df.select("i", X.policy_entities(F.col("c"), terms).alias("x"))
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in found.collect():
        text = " " + (texts[r["i"]] or "").lower().replace("#", " ").replace("_", " ").replace("  ", " ") + " "
        assert r["x"] == sorted(t for t in terms if t in text)
    assert one(spark, "aab aa", lambda c: X.policy_words(c, ["aa", "aab", "aab_aa", "b aa", "a"])) == ["aa", "aab", "aab_aa"]
    assert one(spark, "aab", lambda c: X.policy_entities(c, [])) == [] and one(spark, None, lambda c: X.policy_words(c, ["a"])) == []


def test_policy_terms(spark):
    assert one(spark, "A #red_fox jumps", lambda c: X.policy_entities(c, ["red fox", "blue"])) == ["red fox"]
    assert one(spark, "well-read red_fox", lambda c: X.policy_words(c, ["red_fox", "read", "well-read"])) == ["red_fox", "well-read"]
    assert one(spark, {"bad": 0.2, "worse": 0.1, "ok": 0.9}, lambda c: X.policy_scores(c, ["bad", "worse"]), "map<string,double>") == ["bad"]
    for rating, rule in (("general", False), ("g", False), ("explicit", True), (None, True)):
        assert one(spark, rating, X.restricted_rating) is rule


def test_pseudonymise_longest_first_at_boundaries(spark):
    labels = {"fox": "A", "fox den": "B"}
    assert one(spark, "fox den, fox; foxes x/fox fox/y", lambda c: X.pseudonymise(c, labels)) == "B, A; foxes x/fox fox/y"


def test_category_gate_and_edges(spark):
    rules = [("photo", {"p": 0.5}), ("text", {"t": 0.3})]
    fn = lambda c: X.category_cascade(c, rules, {}, "other")
    assert one(spark, {"p": 0.5, "t": 0.9}, fn, "map<string,double>") == "photo"
    assert one(spark, {"t": 0.3}, fn, "map<string,double>") == "text"
    assert one(spark, {"t": 0.29}, fn, "map<string,double>") == "other"


def test_families_and_prefix(spark):
    fn = lambda c: X.families(c, {"x": "F"}, "untagged", "other")
    assert [one(spark, v, fn, "array<string>") for v in (["x", "x"], [], ["q"])] == [["F"], ["untagged"], ["other"]]
    prefix = lambda c: X.available_prefix(["A", "B", "C"], c)
    assert [one(spark, v, prefix, "array<string>") for v in (["A", "C"], ["B"], ["C", "B", "A"])] == [["A"], [], ["A", "B", "C"]]


def test_union_typed_text(spark):
    fn = lambda c: X.flatten_text(F.try_variant_get(F.parse_json(c), "$.text", "variant"))
    assert one(spark, '{"text": "plain"}', fn) == "plain"
    assert one(spark, '{"text": ["a ", {"type": "b", "text": "c"}, "!"]}', fn) == "a c!"


def test_ads(spark):
    fn = lambda c: X.ad_signals(c, F.array(F.lit("logo")), F.lit("my_channel"), "(?i)price", "(?i)welcome", ["logo"], "(?i)#by", ["own.site"])
    assert one(spark, "price https://other.org", fn) == ["text", "link", "image:logo"]
    assert one(spark, "see t.me/my_channel and https://own.site/x", fn) == ["image:logo"]
    assert one(spark, "#by me price", fn) == []


def test_jpeg_quality(spark):
    assert one(spark, list(X.JPEG_BASE), X.jpeg_quality, "array<int>") == 50.0
    assert one(spark, [4 * b for b in X.JPEG_BASE], X.jpeg_quality, "array<int>") == 12.5
    assert one(spark, [1, 2], X.jpeg_quality, "array<int>") is None


def test_fit_within_rounds_half_even(spark):
    df = spark.createDataFrame([(2560, 1281), (10, 5), (4000, 1)], "w int, h int")
    w, h = N.fit_within(F.col("w"), F.col("h"), 1280)
    assert [tuple(r) for r in df.select(w, h).collect()] == [(1280, 640), (10, 5), (1280, 1)]


def test_gelu(spark):
    xs = [i / 7 for i in range(-40, 41)]
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).select(N.gelu(F.col("x")).alias("g")).toPandas()["g"]
    assert max(abs(g - 0.5 * x * (1 + math.erf(x / math.sqrt(2)))) for g, x in zip(df, xs, strict=True)) < 1e-6


def test_vectors(spark):
    assert one(spark, [1.0, 1.0], V.thumb_vector, "array<double>") is None
    assert one(spark, [1.0, 3.0], V.thumb_vector, "array<double>") == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert one(spark, [float(i) for i in range(72)], V.dhash, "array<double>") == -1
    blocks = lambda c: V.select_blocks(c, ["A", "B"], {"A": 1, "B": 2}, ["B"])
    assert one(spark, [1.0, 2.0, 3.0], blocks, "array<double>") == [2.0, 3.0]
    assert one(spark, [8.0, 9.0], blocks, "array<double>") == [8.0, 9.0]
    with pytest.raises(Exception, match="too short"):
        one(spark, [1.0], blocks, "array<double>")
