"""Similarity joins and clusters against brute force, with small chunks so that cells and grids are exercised."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provspark.functions import vectors as V
from provspark.operators import clusters as C
from provspark.operators import similarity as D
from provspark.plans import dedup_queries as Q


def vectors(n, dim=8, seed=0, near=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if near:
        v[:near] = v[0] + rng.normal(scale=0.05, size=(near, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(v)), "vec": [x.tolist() for x in v]}))


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 40)


@pytest.mark.parametrize("limit", [None, 0.9])
def test_nearest_cosine(spark, small_chunks, limit):
    a, b = vectors(150, seed=1), vectors(400, seed=2, near=140)  # one hot neighbourhood of a third
    sims = a @ b.T
    got = {r["a_id"]: (r["b_id"], r["cosine"]) for r in D.nearest_cosine(frame(spark, a), frame(spark, b), limit).collect()}
    want = {i: (int(s.argmax()), s.max()) for i, s in enumerate(sims) if limit is None or s.max() >= limit}
    assert set(got) == set(want)
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_near_pairs_with_copies(spark, small_chunks):
    v = vectors(200, seed=3, near=60)
    v[150] = v[10]
    v[151] = v[10]
    got = {(r["a_id"], r["b_id"]) for r in D.near_pairs(frame(spark, v), 0.9).collect()}
    sims = v @ v.T
    distinct = [i for i in range(200) if i not in (150, 151)]
    want = {(i, j) for i in distinct for j in distinct if i < j and sims[i, j] >= 0.9} | {(10, 150), (10, 151)}
    assert got == want


@pytest.mark.parametrize("chunk", [16, 8192])
def test_nearest_hamming(spark, monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    b = rng.integers(-(2**63), 2**63 - 1, 300)
    flips = [sum(1 << int(k) for k in rng.choice(63, m, replace=False)) for m in rng.integers(0, 10, 200)]
    a = b[:200] ^ np.array(flips, dtype=np.int64)
    got = {
        r["a_id"]: r["distance"]
        for r in D.nearest_hamming(
            spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "hash": a})),
            spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "hash": b})),
        ).collect()
    }
    far = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]).min(1)
    assert got == {i: int(d) for i, d in enumerate(far) if d <= 6}


def greedy(v, limit):
    leader = {}
    for i in range(len(v)):
        if i in leader:
            continue
        for j in range(i, len(v)):
            if j not in leader and v[i] @ v[j] >= limit - 1e-12:
                leader[j] = i
    return leader


def test_leader_clusters_equal_the_sequential_order(spark, small_chunks):
    v = vectors(160, dim=4, seed=6, near=50)
    got = {r["id"]: r["leader"] for r in C.leader_clusters(frame(spark, v), 0.85).collect()}
    assert got == greedy(v, 0.85)


def test_leader_chain_is_not_merged(spark):
    angles = np.radians([0, 20, 40])
    df = frame(spark, np.stack([np.cos(angles), np.sin(angles)], 1))
    alone = spark.createDataFrame([(9, None)], df.schema)
    got = {r["id"]: r["leader"] for r in C.leader_clusters(df.unionByName(alone), np.cos(np.radians(25))).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 9: 9}


def test_connected_groups(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(2000, 2001 + i) for i in range(120)]  # a hub
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if a != b and ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in C.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_contamination_keeps_existing_reasons(spark):
    train = spark.createDataFrame([(1, None), (2, "foto"), (3, None)], "id long, reason string")
    hits = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2)], "channel string, b_id long")
    got = {r["id"]: r["reason"] for r in D.mark_contaminated(train, hits, "id").collect()}
    assert got == {1: "dublette: b", 2: "foto", 3: None}


def test_leaders_when_lists_run_out(spark, small_chunks, monkeypatch):
    monkeypatch.setattr(C, "NEIGHBOURS", 1)  # rows with more neighbours are joined again
    v = vectors(120, dim=3, seed=11, near=40)
    got = {r["id"]: r["leader"] for r in C.leader_clusters(frame(spark, v), 0.9).collect()}
    assert got == greedy(v, 0.9)


def test_packed_counts_stand_for_the_text_vectors_and_signatures_are_no_farther(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdeé ")) for _ in range(n)) for n in (0, 2, 3, 40, 400, 3000)] + ["aaaaaa", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    packed = D.text_vectors(df, "id").collect()
    plain = {r["id"]: r["v"] for r in df.select("id", V.text_thumb(F.col("text")).alias("v")).collect() if r["v"] is not None}
    assert {r["id"] for r in packed} == set(plain)
    for r in packed:
        assert np.allclose(V.unpack_units([bytes(r["vec"])])[0], plain[r["id"]], atol=1e-12)
    x = vectors(60, dim=100, seed=8)
    s = D._signature(x, D._basis(x[:20]))
    assert s.shape == (60, 65) and np.allclose((s * s).sum(1), 1)
    far = lambda y: np.linalg.norm(y[:, None] - y[None], axis=2)
    assert (far(s) <= far(x) + 1e-9).all()


def test_rows_leave_python_once_however_many_chunk_pairs_they_go_to():
    v = vectors(1000, seed=12)
    cells = D.VectorCells(v[:40])
    batch = pa.RecordBatch.from_pydict({"id": np.arange(1000), "vec": v.tolist(), "radius": np.full(1000, 2.0)})
    counts = np.arange(40), np.full(40, 5 * cells.chunk)  # every cell holds five chunks of either side
    out = list(D.addressed(iter([batch]), cells.visits, counts, counts, cells.chunk, True))
    assert max(b.num_rows for b in out) <= D.SLICE and sum(b.num_rows for b in out) == 1000
    goals = [g for b in out for g in b.column("_to").to_pylist()]
    assert all({(t["cell"], t["j"]) for t in g} == {(c, j) for c in range(40) for j in range(5)} for g in goals)
    assert all(len(g) == 200 and len({(t["cell"], t["i"]) for t in g}) == 40 for g in goals)


def test_long_texts_are_counted_few_at_a_time():
    texts = ["ab" * 40, "c" * 5, "d" * 5, "", "efg" * 50, "h"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": texts})
    assert [p.column("text").to_pylist() for p in V._short_runs(batch, 2, 20)] == [[texts[0]], texts[1:3], [""], [texts[4]], ["h"]]
    one, whole = (list(V.packed_trigrams(iter([batch]), most=n)) for n in (20, 1 << 20))
    assert pa.Table.from_batches(one).to_pylist() == pa.Table.from_batches(whole).to_pylist()


def test_quantiles_of_best_matches_search_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def searched(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def nearest(left, right):
        return spark.range(100).selectExpr("id as a_id", "id as b_id", "id / 100d as cosine").mapInArrow(searched, D.BEST)

    monkeypatch.setattr(Q, "sides", lambda spark, sf: (None, None))
    monkeypatch.setattr(D, "nearest_cosine", nearest)
    assert Q.a25(spark, "").first()["q0"] == pytest.approx(0.495)
    assert read.value == 100


def test_sorted_pairs_search_once(spark, monkeypatch, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def searched(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def pairs(spark, sf):
        return spark.range(100).selectExpr("id as a_id", "id + 1 as b_id", "id % 7 / 100d as cosine").mapInArrow(searched, D.BEST)

    monkeypatch.setattr(Q, "j12", pairs)
    got = [(r["a_id"], r["cosine"]) for r in Q.t04(spark, "").collect()]
    assert got == sorted(((i, i % 7 / 100) for i in range(100)), key=lambda r: (-r[1], r[0]))
    assert read.value == 100


def test_copies_of_rows_grow_no_faster_than_the_rows(spark, small_chunks):
    """Chunks grow with the rows, and of a table with itself a pair meets once: so few copies of a row are made."""
    copies = []
    for n in (1500, 6000):
        cells = D.OwnCells(D.vector_cells(frame(spark, vectors(n, seed=13))))
        rows = cells.place(frame(spark, vectors(n, seed=13))).withColumn("radius", F.lit(2.0))
        counts = D._cell_counts(rows, cells.visits), D._cell_counts(rows, cells.home)
        left = D._spread(rows, cells.visits, *counts, cells.chunk, True).select("id", "cell", "j").distinct().count()
        copies.append(left / n)
    assert copies[1] < 1.3 * copies[0]


def test_pairs_of_a_table_with_itself_meet_once(spark, small_chunks):
    v = vectors(300, seed=14, near=100)
    cells = D.OwnCells(D.vector_cells(frame(spark, v)))
    rows = cells.place(frame(spark, v))

    def met(cell, x, y):
        a, b = (g.ravel() for g in np.meshgrid(x.ids, y.ids, indexing="ij"))
        once = a < b if cell % 2 == 0 else np.ones(len(a), bool)
        yield np.minimum(a, b)[once], np.maximum(a, b)[once]

    got = [(r["a"], r["b"]) for r in D.cell_join(rows.withColumn("radius", F.lit(2.0)), rows, cells, "vec", met, "a bigint, b bigint").collect()]
    assert sorted(got) == [(a, b) for a in range(300) for b in range(a + 1, 300)]


def test_pairs_leave_a_chunk_block_by_block():
    """All rows of both sides are near each other; no block gives more than its rows times its columns."""
    v = vectors(9000, dim=4, seed=15, near=9000)
    ids = np.arange(9000)
    x, y = D.Side(ids, pa.array(v.tolist())), D.Side(ids, pa.array(v.tolist()))
    sizes = [len(D._near(a, b, 0.9)[0]) for _, _, a, b in D._blocks(x, y, later=True)]
    assert max(sizes) <= D.BLOCK * D.ACROSS and len(sizes) < -(-9000 // D.BLOCK) * -(-9000 // D.ACROSS)


@pytest.mark.parametrize("kind", ["list", "binary", "long"])
def test_a_chunk_is_held_once_when_its_products_begin(kind):
    rng = np.random.default_rng(20)
    ids = rng.permutation(6000)
    values = {"list": vectors(6000, dim=64, seed=20).tolist(), "binary": [rng.bytes(300) for _ in ids], "long": ids * 7}[kind]
    parts = [pa.RecordBatch.from_pydict({"id": ids[a : a + 2000], "value": values[a : a + 2000]}) for a in range(0, 6000, 2000)]
    want = pa.Table.from_batches(parts).sort_by("id").to_pydict()
    held = pa.total_allocated_bytes()
    size = sum(p.get_total_buffer_size() for p in parts)
    side = D._side(parts)
    assert side.ids.tolist() == want["id"] and side.values.to_pylist() == want["value"]
    if kind != "long":  # numbers made by numpy are not Arrow's to free
        assert pa.total_allocated_bytes() < held + 0.2 * size


def most_held(work) -> int:
    """Bytes that Python and numpy hold at most during the work."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_rows_of_a_search_are_dealt_in_the_same_memory_however_many_they_are():
    """A search without a limit: every row visits all five chunks of all 40 cells."""
    cells, held = D.VectorCells(vectors(40, seed=21)), []
    counts = np.arange(40), np.full(40, 5 * cells.chunk)
    for n in (1000, 8000):
        batch = pa.RecordBatch.from_pydict({"id": np.arange(n), "vec": vectors(n, seed=22).tolist(), "radius": np.full(n, 2.0)})
        dealt = lambda b=batch: sum(x.num_rows for x in D.addressed(iter([b]), cells.visits, counts, counts, cells.chunk, True))
        assert dealt() == n
        held.append(most_held(dealt))
    assert held[1] < 1.2 * held[0]


def test_a_search_holds_the_products_of_two_blocks_at_most():
    a, b, ids = vectors(9000, seed=23), vectors(12000, seed=24), np.arange(12000)
    x, y, out = D.Side(ids[:9000], pa.array(a.tolist())), D.Side(ids, pa.array(b.tolist())), []
    assert most_held(lambda: out.extend(D._cosine_best(0, x, y))) < 2.5 * 8 * D.BLOCK * D.ACROSS
    (left, right, cosine), sims = out[0], a[:300] @ b.T
    assert left.tolist() == x.ids.tolist() and right[:300].tolist() == sims.argmax(1).tolist()
    assert np.allclose(cosine[:300], sims.max(1), atol=1e-14)


@pytest.mark.parametrize("cosines", [True, False])
def test_single_precision_decides_nothing(cosines):
    rng = np.random.default_rng(19)
    a = vectors(400, dim=1000, seed=16)
    b = a + rng.normal(scale=1e-3, size=a.shape)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    sims = a @ b.T
    limit = float(np.sort(sims.diagonal())[200:202].mean())  # many rows are nearer to it than the margin
    i, j, cosine = D._near(a, b, limit, cosines)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(sims >= limit), strict=True))
    assert not cosines or np.abs(cosine - sims[i, j]).max() < 1e-14


def test_packed_counts_take_a_bit_for_each_bin_and_few_bytes_for_a_count():
    rng = np.random.default_rng(17)
    counts = rng.integers(0, 5, (4, V.BINS)) * rng.integers(0, 2, (4, V.BINS))
    counts[1, 5], counts[2, 6], counts[3] = 70_000, 300, 0
    packed = V.pack_counts(counts)
    assert len(packed[0]) == 129 + (counts[0] > 0).sum() and len(packed[3]) == 129
    centred = counts - counts.mean(axis=1, keepdims=True)
    want = centred / np.maximum(1e-300, np.linalg.norm(centred, axis=1, keepdims=True))
    assert np.allclose(V.unpack_units(packed), want, atol=1e-15)


def test_clusters_of_many_rows_in_one_chunk(spark):
    v = vectors(6000, dim=3, seed=18, near=2000)
    got = {r["id"]: r["leader"] for r in C.leader_clusters(frame(spark, v), 0.995).collect()}
    want = np.full(len(v), -1)
    for i in range(len(v)):
        if want[i] < 0:
            want[(want < 0) & (v @ v[i] >= 0.995) & (np.arange(len(v)) >= i)] = i
    assert got == dict(enumerate(want.tolist()))


def test_rounds_leave_the_planner_nothing_to_carry_on(spark):
    from provspark.session import cut_round

    rows = spark.range(50).selectExpr("id", "id % 3 as near").where("near > 0")
    known = []
    for _ in range(3):
        rows = cut_round(rows.selectExpr("id", "near", "CASE WHEN near = 1 THEN id END AS leader").where("id >= 0").select("id", "near"))
        known.append(rows._jdf.queryExecution().optimizedPlan().constraints().size())
    assert max(known) <= 1
    assert sorted(map(tuple, rows.collect())) == [(i, i % 3) for i in range(50) if i % 3]


def test_rounds_tell_the_planner_how_large_they_are(spark):
    """Rounds that join each other: the planner's guess of a size does not grow with their number."""
    from provspark.session import cut_round

    rows = spark.range(50).selectExpr("id", "id % 7 as near")
    for _ in range(6):
        rows = cut_round(rows.join(rows.selectExpr("id as near"), "near").select("id", "near"))
    guess = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert guess < 1 << 20
    assert sorted(map(tuple, rows.collect())) == [(i, i % 7) for i in range(50)]


def test_chunks_of_text_vectors_stay_few_at_millions_of_rows():
    """Each row travels once for each chunk that it meets; a chunk has a ceiling, so that a worker's memory has one, too."""
    for n in (50_000, 250_000, 3_000_000):
        assert -(-n // D.chunk_rows(n, packed=True)) <= D.CHUNKS + 1
    assert D.chunk_rows(10**9, packed=True) == 4 * D.WIDEST and D.chunk_rows(10**9, packed=False) == D.WIDEST


def test_sorted_pairs_let_go_of_the_shuffle_of_the_search(spark, monkeypatch):
    """What the search wrote to shuffles is gone when the sort begins."""
    from pathlib import Path
    from time import sleep

    manager = spark.sparkContext._jsc.env().blockManager().diskBlockManager()

    def shuffled():
        files = [p for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*.data")]
        return {p for p in files if p.exists() and p.stat().st_size}

    before = shuffled()
    pairs = lambda spark, sf: spark.range(5000).selectExpr("id % 100 as a_id", "id as b_id", "1d as cosine").repartition(4, "a_id")
    monkeypatch.setattr(Q, "j12", pairs)
    out = Q.t04(spark, "")
    for _ in range(50):  # files are deleted in the background
        if not shuffled() - before:
            break
        sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 5000
