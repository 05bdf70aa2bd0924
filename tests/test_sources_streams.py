"""Sources, sinks and streams on small files."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from provspark.operators.admission import admit_with_quota
from provspark.operators.messages import carry_caption, pair_tokens
from provspark.plans import curation_queries, model_queries
from provspark.sources import exports, manifests, tables
from provspark.streaming.admit import admit_stream


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_manifest_rows_with_fewer_keys(spark, folder):
    rows = [{"id": 1, "datei": "a", "tags": ["x"]}, {"id": "b", "grund": "foto"}, {"id": 3, "datei": "c", "grund": "gesperrt"}]
    with open(f"{folder}/m.jsonl", "w") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    with pytest.raises(Exception, match="unreadable manifest line: .broken"):
        manifests.read_manifest(spark, f"{folder}/m.jsonl").collect()
    assert [r["value"] for r in manifests.unreadable_lines(spark, f"{folder}/m.jsonl").collect()] == ["{broken"]
    df = manifests.read_manifest(spark, f"{folder}/m.jsonl", skip_unreadable=True)
    assert sorted(r["id"] for r in df.collect()) == ["1", "3", "b"]
    assert [r["id"] for r in manifests.kept_rows(df).collect()] == ["1"]


def test_rewrite_swaps_whole_versions(spark, folder):
    one = spark.createDataFrame([("1", "foto")], "id string, grund string")
    manifests.rewrite_manifest(one, folder)
    manifests.rewrite_manifest(manifests.current_manifest(spark, folder).select("id", F.lit("x").alias("grund")), folder)
    assert [tuple(r) for r in manifests.current_manifest(spark, folder).select("id", "grund").collect()] == [("1", "x")]


def test_unknown_keys_survive_a_rewrite(spark, folder):
    lines = [{"id": "1", "url": 'a"b', "vae": {"k": [1, 2.5]}, "n": None}, {"id": "2"}, {"dublette_von": "x"}]
    with open(f"{folder}/m.jsonl", "w") as f:
        f.write("\n".join(map(json.dumps, lines)))
    df = manifests.read_manifest(spark, f"{folder}/m.jsonl")
    manifests.rewrite_manifest(df.withColumn("grund", F.when(F.col("id") == "2", "foto")), f"{folder}/t")
    again = manifests.current_manifest(spark, f"{folder}/t")
    assert {r["id"]: r["grund"] for r in again.collect()} == {"1": None, "2": "foto", None: None}
    found = [json.loads(r["rest"] or "{}") for r in again.collect()]
    assert all({k: v for k, v in line.items() if k != "id"} in found for line in lines)


def test_file_scan(spark, folder):
    import os

    os.makedirs(f"{folder}/a/_ai_quarantine")
    for name in ("a/x.JPG", "a/y_thumb.jpg", "a/z.txt", "a/_ai_quarantine/q.jpg", "w.png"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("data")
    names = {r["path"].rsplit("/", 1)[1] for r in manifests.scan_files(spark, folder, ["jpg", "png"]).collect()}
    assert names == {"x.JPG", "w.png"}


def test_chat_export(spark, folder):
    doc = {
        "name": "c",
        "messages": [
            {"id": 1, "type": "message", "date": "d", "text": "hi", "photo": "p.jpg"},
            {"id": 2, "type": "service", "date": "d", "text": ""},
            {"id": 3, "type": "message", "date": "d", "text": ["a", {"type": "b", "text": "b"}], "via_bot": "@x"},
        ],
    }
    with open(f"{folder}/result.json", "w") as f:
        json.dump(doc, f, indent=1)
    rows = exports.read_chat_export(spark, f"{folder}/result.json").orderBy("msg").collect()
    assert [(r["msg"], r["text"], r["photo"], r["via_bot"]) for r in rows] == [(1, "hi", "p.jpg", False), (3, "ab", None, True)]


def test_numbered_pages(spark, folder):
    for name in ("messages.html", "messages2.html", "messages10.html"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("<html>\n</html>")
    assert sorted(r["page_no"] for r in exports.read_html_export(spark, folder).collect()) == [1, 2, 10]


def test_csv_with_byte_order_mark(spark, folder):
    with open(f"{folder}/c.csv", "w", encoding="utf-8-sig") as f:
        f.write('id,prompt\n1,"two\nlines"\n')
    assert [tuple(r) for r in tables.read_catalog_csv(spark, f"{folder}/c.csv").select("id", "prompt").collect()] == [("1", "two\nlines")]


def test_captions_carry_within_one_timestamp(spark):
    rows = [("c", 1, "t1", "cat", False), ("c", 2, "t1", "", False), ("c", 3, "t2", "", False), ("c", 4, "t2", "ad", True),
            ("c", 5, "t2", "", False), ("d", 6, "t2", "", False)]
    out = carry_caption(spark.createDataFrame(rows, "channel string, msg long, ts string, text string, via_bot boolean"))
    assert {r["msg"]: r["text"] for r in out.collect()} == {1: "cat", 2: "cat", 3: "", 5: "ad", 6: ""}


def test_pairs_survive_a_page_break(spark):
    rows = [(1, 0, "photo", "a"), (1, 1, "photo", "b"), (1, 2, "thumb", "t"), (2, 0, "post", "1"), (2, 1, "post", "2"),
            (2, 2, "photo", "c"), (3, 0, "post", "3")]
    out = pair_tokens(spark.createDataFrame(rows, "page long, pos int, kind string, value string"))
    assert {r["post"]: r["photo"] for r in out.collect()} == {"1": "b", "3": "c"}


@pytest.mark.parametrize("cuts", [[0, 40], [0, 7, 20, 40]])
def test_stream_equals_batch_and_repeats_safely(spark, folder, cuts):
    rows = [(i, None if i % 9 == 0 else f"u{i % 4 and 1}", ["bad"] if i % 5 == 0 else [], "text", "general", (i % 10) / 10.0, 600, 600) for i in range(40)]
    df = spark.createDataFrame(
        rows, "item_id long, creator string, tags array<string>, text string, rating string, real_score double, w int, h int"
    )
    policy = {"tags": ["bad"]}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        df.where((F.col("item_id") >= a) & (F.col("item_id") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        admit_stream(stream, f"{folder}/log", f"{folder}/cp", "prompted", policy, 3).awaitTermination()

    run()
    df.where("item_id < 5").coalesce(1).write.mode("append").parquet(f"{folder}/in")  # arrives again: skipped
    run()
    got = {r["item_id"]: r["reason"] for r in spark.read.parquet(f"{folder}/log").collect()}
    want = {r["item_id"]: r["reason"] for r in admit_with_quota(df, "prompted", policy, 3).collect()}
    assert got == want


def test_arrivals_of_many_files_are_decided_in_item_order(spark, sf, folder):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs.repartition(6, "doc_id").write.parquet(f"{folder}/documents.parquet")  # each file holds items from everywhere
    labels.write.parquet(f"{folder}/labels.parquet")
    got = {r["item_id"]: r["reason"] for r in model_queries.z01(spark, folder).collect()}
    assert got == {r["item_id"]: r["reason"] for r in curation_queries.p04_quota(spark, folder).collect()}


def test_report_with_more_unscored_rows_than_a_range_holds(spark, folder):
    df = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(300)], "item_id long, score double")
    tables.write_scores_csv(df, f"{folder}/s", "item_id")
    got = {int(r["item_id"]): (int(r["place"]), r["probability"]) for r in spark.read.csv(f"{folder}/s", sep=";", header=True).collect()}
    order = sorted(range(300), key=lambda i: (i % 3 != 0, -i if i % 3 == 0 else i))
    assert {i: p for i, (p, _) in got.items()} == {i: place + 1 for place, i in enumerate(order)}
    assert all((p is None) == (i % 3 != 0) for i, (_, p) in got.items())
