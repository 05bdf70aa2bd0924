import numpy as np
from pyspark.sql import functions as F

from provspark.llm import near_vectors
from provspark.llm.near_vectors import near_duplicates, neighbours, passes_for
from provspark.llm.near_vectors_query import op9


def plain(rows, at_least=0.9):
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    linked = x @ x.T >= at_least
    np.fill_diagonal(linked, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
        if (low == label).all():
            break
        label = low
    out = {int(i): (int(n), int(c), i == c) for i, n, c in zip(ids, linked.sum(axis=1), label, strict=True)}
    return {i: out.get(i, (0, i, True)) for i, _ in rows if i is not None}


def clusters(sizes, noise, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [(centre + rng.normal(size=dim) * noise / np.sqrt(dim)).tolist() for _ in range(n)]
    order = rng.permutation(len(out))
    return [(int(i), out[k]) for i, k in enumerate(order)]


def test_groups_larger_than_a_window(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "WINDOW", 16)
    rows = clusters([150, 40, 3, 2, *[1] * 200], 0.12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "block": F.lit(2)})
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicates(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    links = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) <= links
    assert sum(n for n, _, _ in got.values()) >= 0.98 * links
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.99 * len(want)


def test_looser_pairs_are_found_by_the_passes(spark):
    rows = clusters([2] * 150, 0.28, seed=3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()}
    want = {i: n for i, (n, _, _) in plain([(r["vec_id"], r["embedding"]) for r in df.collect()]).items()}
    assert sum(want.values()) > 50
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_copies_odd_vectors_and_empty(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]),
            (9, [float("inf"), 1.0]), (10, [None, 1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = near_duplicates(df).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got if r["vec_id"] is not None} == plain(rows)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_query_and_number_of_passes(spark, sf):
    assert op9(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert passes_for(10**5)[0] < passes_for(10**7)[0]


def test_pairs_just_above_the_limit_are_found_in_many_windows(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "WINDOW", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    a, z = x[:10000], x[10000:]
    z = z - (z * a).sum(axis=1)[:, None] * a
    z /= np.sqrt((z * z).sum(axis=1))[:, None]
    cosine = rng.uniform(0.9001, 0.92, 10000)[:, None]
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * z])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert sum(got[i] == got[i + 10000] for i in range(10000)) >= 0.996 * 10000


def test_passes_follow_the_least_cosine():
    assert [passes_for(n, 0.9)[0] for n in (50_000, 10**6, 10**7, 3 * 10**7)] == [19, 38, 72, 84]
    assert passes_for(10**6, 0.95)[0] < passes_for(10**6, 0.9)[0] and passes_for(10**6, 1.0)[0] == 4


def test_rows_travel_little_more_than_once_in_a_pass(spark):
    """Rows of neighbouring blocks share a group in each pass, which only the first block of a span leaves for a second one."""
    n, passes = 100 * 50, 3
    blocks = [[int(b) for b in (np.roll(np.arange(n), 7 * p) // 50)] for p in range(passes)]
    rows = spark.createDataFrame([(i, list(b)) for i, b in enumerate(zip(*blocks, strict=True))], "id long, blocks array<int>")
    met = neighbours(rows).select("pass", "tile", "id", "block").collect()
    assert len(met) <= (1 + 1 / near_vectors.SPAN) * passes * n
    groups = {}
    for p, tile, _, block in met:
        groups.setdefault((p, tile), set()).add(block)
    for p in range(passes):
        for b in range(100):
            own = groups[p, b // near_vectors.SPAN]
            assert b in own and (b == 99 or b + 1 in own)
