import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm.decontaminate import build_index, contaminated, decontaminated, hits_of
from provspark.llm.decontaminate_query import op11, told

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, window=10):
    index = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in index}:
            for i in range(len(w) - m + 1):
                own = index.get(tuple(w[i : i + m]))
                if own:
                    hit |= set(range(i, i + m))
                    found |= {x for x in own if x is not None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_on_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(op11(spark, sf))
    assert got == plain(docs, items) and any(r[-1] for r in got)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Ünder", "x9", "C"]) if rng.random() < 0.5 else "w%d" % rng.randrange(40)
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(30)]
    items += [(None, some(12)), (100, None), (101, ""), (102, "--- !"), (103, items[0][1]), (3, some(15)), (-7, items[5][1])]
    texts = [some(rng.randrange(0, 60)) for _ in range(60)]
    for i in range(40):
        texts[i] += rng.choice([" ", "\n", "-\x00-"]) + (items[rng.randrange(31)][1] or "") + rng.choice(["", " tail"])
    docs = list(enumerate(texts)) + [(500, None), (501, ""), (502, "!?"), (None, items[30][1]), (7, texts[8]), (9, texts[9])]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [8 << 20, 300])
def test_equals_brute_force_in_one_block_or_many(spark, seed, block):
    docs, items = cases(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(told(df, bench, block_bytes=block)) == plain(docs, items)


def test_long_items_are_cut_and_long_texts_read_whole(spark):
    rng = random.Random(5)
    long = " ".join("t%d" % rng.randrange(10**6) for _ in range(9000))
    w = long.split()
    docs = [(1, " ".join(w[4090:4106])), (2, "z " * 300_000 + " ".join(w[-10:])), (3, " ".join(w[4090:4099])), (4, long)]
    items = [(1, long)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert rows(told(df, bench)) == want == rows(told(df, bench, block_bytes=20_000))
    assert [r[2] for r in want] == [16, 10, 0, 9000]


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    import provspark.llm.decontaminate as d

    monkeypatch.setattr(d, "mix", lambda x: x & np.uint64(3))  # four hashes for all windows
    docs, items = cases(1)
    texts = [(t or "").encode() for _, t in docs]
    normal = [" ".join(words(t)).encode() for _, t in items]
    index = build_index([i for i, _ in items], normal)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found, hit, doc, item = hits_of(raw, offsets, index)
    want = {r[0]: r for r in plain([(n, t) for n, (_, t) in enumerate(docs)], items)}
    for n in range(len(docs)):
        assert hit[found.first[n] : found.first[n + 1]].sum() == want[n][2] and (doc == n).sum() == want[n][3]
    assert index["most"] > 1


def test_spans_or_documents_go_and_clean_rows_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.upper()}! after Größe", "k"), (2, "all clean, here", "k"), (3, None, None), (4, item, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")  # a column named as one of the new ones
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminated(df, bench).collect()}
    assert got == {1: "Before, ! after Größe", 2: "all clean, here", 3: None, 4: ""}
    assert sorted(r["doc_id"] for r in decontaminated(df, bench, "documents").collect()) == [2, 3]
    found = {r["doc_id"]: r for r in contaminated(df, bench).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(1, 12, 8, 8 + len(item))] and found[1]["items"] == [9]
    with pytest.raises(ValueError):
        decontaminated(df, bench, "words")


def test_empty_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert told(docs.limit(0), bench).collect() == []
    none = told(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("contaminated or n_items > 0").isEmpty()
    assert none.where(F.col("n_words") > 0).count() > 0
