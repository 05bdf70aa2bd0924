import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm.jaccard import needed, occurrences, similar
from provspark.llm.jaccard_query import grouped, op10

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(rows):
    sets, lists = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    common = Counter((a, b) for l in lists.values() for a in l for b in l if a < b)
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op10(spark, sf).collect()} == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_groups_chains_and_common_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    common = [word() for _ in range(60)]
    texts = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 80, 200]))]
        if g % 3 == 0:
            base[3:3] = common
        for _ in range(rng.choice([1, 2, 5, 30])):
            edit = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                edit[rng.randrange(len(edit))] = word()
            texts.append(" ".join(edit))
    chain = [word() for _ in range(120)]
    for k in range(12):  # each links with the next, not with all
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [" ".join(common)] * 5 + [" ".join(common[: 40 + k]) for k in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "n": F.lit(1), "h": F.lit(2)})
    assert {r[0]: tuple(r)[1:] for r in grouped(df).collect()} == plain(rows)
    _, links = similar(df)
    sets = {i: shingles(t) for i, t in rows}
    for r in links.collect():
        c = len(sets[r["a"]] & sets[r["b"]])
        assert c == r["overlap"] and 100 * c >= 75 * len(sets[r["a"]] | sets[r["b"]])


def test_odd_rows(spark):
    forty = " ".join(f"x{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "A B\x0bc"), (6, "a b c d"), (7, "w " * 30000), (8, "w w w w w w"),
            (9, forty), (10, forty + " y"), (11, forty), (12, "Ä b c"), (13, "ä b c"), (14, "a b c")]
    df = spark.createDataFrame([*rows, (10, forty + " y"), (None, "a b c")], "doc_id long, text string")
    got = [tuple(r) for r in grouped(df).collect()]
    assert len(got) == 16 and (None, 1, None) in got and got.count((10, 37, 9)) == 2
    assert {r[0]: r[1:] for r in got if r[0] is not None} == plain(rows)
    assert grouped(df.limit(0)).collect() == []
    torn = spark.createDataFrame([(1, forty), (1, "other words than the ones before"), (2, forty)], "doc_id long, text string")
    assert sorted(tuple(r) for r in grouped(torn).collect()) == [(1, 2, 1), (1, 36, 1), (2, 36, 1)]


def test_search_keeps_exactly_the_sets_with_the_needed_overlap():
    rng = np.random.default_rng(5)
    for _ in range(30):
        query = rng.choice(10**6, rng.integers(1, 200), replace=False)
        sets = []
        for _ in range(rng.integers(1, 40)):
            keep = query[rng.random(len(query)) < rng.choice([0.3, 0.8, 0.95, 1])]
            sets.append(np.concatenate([keep, rng.integers(10**6, 10**7, rng.integers(0, 40))]))
        sizes = np.array([max(1, len(s)) for s in sets])
        overlap = np.array([len(np.intersect1d(query, s)) for s in sets])
        want = np.where(overlap >= needed(len(query), sizes), overlap, 0)
        assert (occurrences(query, len(query), sets, sizes) == want).all()
