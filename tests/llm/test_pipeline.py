from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provspark.llm.components import components
from provspark.llm.mixing import mix
from provspark.llm.mixing_query import domains
from provspark.llm.repeats_query import digests
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_repeats import plain as plain_repeats

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "mixing", "byte_bpe"]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    words = {"idiot", "moron", "stupid", "trash", "loser", "pathetic", "scum", "worthless", "clown", "disgusting"}
    before, after = texts(stages[0]), texts(stages[1])
    toxic = {i for i, t in before.items() if len(words & set(t.lower().replace(",", " ").replace(".", " ").split())) >= 2}
    assert toxic and not toxic & after.keys()
    assert len(before.keys() - after.keys() - toxic) <= 0.02 * len(before)
    assert all(before[i] == t for i, t in after.items())


def test_one_document_of_each_group_stays(stages):
    before = texts(stages[1])
    groups = plain_groups(list(before.items()))
    assert texts(stages[2]).keys() == {i for i, (_, c) in groups.items() if i == c}


def test_repeated_passages_go(spark, stages):
    before, after = texts(stages[2]), stages[3].collect()
    want = plain_repeats(before.items())
    assert {r["doc_id"] for r in after} == {i for i, w in want.items() if w[0] == 0 or w[1] < w[0]}
    for r in after:
        n, removed, _, _ = want[r["doc_id"]]
        kept = len(r["text"].encode())
        # characters that a span cuts stay whole: at most three bytes more at each of its ends
        assert n - removed <= kept <= n - removed + 6 * want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"]) or not removed
    assert sum(r["n_removed"] for r in digests(stages[3].select("doc_id", "text")).collect()) < 0.02 * sum(w[0] for w in want.values())


def test_mixing_repeats_and_drops_none(stages):
    before, after = texts(stages[3]), stages[4].collect()
    assert {r["doc_id"]: r["text"] for r in after} == before
    assert len(before) < len(after) <= 4 * len(before)


def test_mixing_reaches_the_target_shares(spark):
    c, sf = corpus_pipeline, "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rated = mix(docs, domains(spark.read.parquet(f"{sf}/labels.parquet")), c.WEIGHTS, c.SCALE, c.LOWEST, c.HIGHEST).collect()
    tokens, p = np.array([r["tokens"] for r in rated]), np.array([r["p"] for r in rated])
    want = np.array(list(c.WEIGHTS.values())) / sum(c.WEIGHTS.values())
    assert (tokens @ p / tokens.sum())[1] > c.SCALE * want[1]  # poor prose has more tokens than 1.2 times all leave it
    often = Counter(r["doc_id"] for r in c.mixed(spark, docs, sf).collect())
    for rates, slack in (([r["rate"] for r in rated], 0.002), ([often[r["doc_id"]] for r in rated], 0.01)):
        totals = (tokens * rates) @ p
        assert abs(totals / totals.sum() - want).max() < slack
    assert len(often) == len(rated) and totals.sum() >= c.SCALE * tokens.sum()


def test_ids_decode_to_the_texts(stages):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = texts(stages[4]), stages[5].collect()
    assert len(after) == stages[4].count() and all(r["round_trip"] for r in after)
    assert all(r["ids"] == plain.encode_ordinary(before[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in after)


def test_odd_rows_pass_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text of no id", "en", "s", 13), (3, "some words here", None, "s", 15)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("x"), "id": F.lit(1), "copies": F.lit(2), "start": F.lit(3)})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).collect()
        assert {r["doc_id"] for r in out} == {1, 2, 3, None}
        assert stage(spark, docs.limit(0), sf).collect() == []
        if k == 1:
            assert len(out) == 4


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3), (2000, 1999)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {1999: 1999, 2000: 1999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
