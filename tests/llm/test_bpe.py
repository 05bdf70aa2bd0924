import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provspark.llm.bpe import Encoder, Vocabulary, decode, encode
from provspark.llm.bpe_query import digests, op7

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wanted(plain, text):
    ids = plain.encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha(plain.decode_bytes(ids))


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_query_equals_the_library_on_a_whole_table(spark, sf, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op7(spark, sf).collect()}
    assert got == {i: wanted(plain, t) for i, t in texts.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(vocabulary, plain, texts):
    rows = Encoder(vocabulary, public_tokenizers.PATTERN).documents(texts)
    assert [memoryview(r).cast("i").tolist() for r in rows] == [plain.encode_ordinary(t) for t in texts]


def test_odd_rows(spark, plain):
    long_match = "ab" * 3000 + "zürich" * 500  # merged with the heap
    texts = [None, "", " " * 4000, long_match, "\n\n\t x", "日本語🙂" * 300, "don't  stop", "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    got = sorted((tuple(r) for r in digests(df).collect()), key=str)
    assert got == sorted(((i, *wanted(plain, t)) for i, t in rows), key=str)
    assert digests(df.limit(0)).collect() == []


def test_operators_keep_other_columns_and_round_trip(spark, vocabulary):
    df = spark.createDataFrame([(1, "größer", 5), (2, None, None)], "k int, text string, ids int")
    out = decode(encode(df, vocabulary, public_tokenizers.PATTERN), vocabulary).orderBy("k").collect()
    assert out[0].asDict().keys() == {"k", "text", "ids", "decoded"}
    assert [bytes(r["decoded"]) for r in out] == ["größer".encode(), b""]
