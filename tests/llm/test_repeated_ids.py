"""One id with several contents, numbers beyond 64 bits, many languages, and workers without the package."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.llm.common import text_digest, with_nodes
from provspark.llm.jaccard_query import grouped
from provspark.llm.langid import predict, train
from provspark.llm.near_vectors import near_duplicates
from provspark.llm.repeats_query import digests
from provspark.llm.topk import top_k

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_nodes_rise_with_ids_and_tell_contents_apart(spark):
    rows = [(3, "a"), (3, "b"), (3, "b"), (3, "c"), (4, "x"), (5, None), (5, ""), (-7, "q"), (-7, "r")]
    df, bits = with_nodes(spark.createDataFrame(rows, "id long, text string"), text_digest())
    got = df.collect()
    assert bits == 2 and all(r["node"] >> bits == r["id"] for r in got) and len(got) == len(rows)
    assert len({r["node"] for r in got}) == 7 and len({(r["id"], r["text"] or "") for r in got}) == 7
    same, none = with_nodes(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, text string"), text_digest())
    assert none == 0 and all(r["node"] == r["id"] for r in same.collect())
    with pytest.raises(OverflowError):
        with_nodes(spark.createDataFrame([*rows, (2**61, "z")], "id long, text string"), text_digest())


def test_jaccard_join_keeps_the_links_of_every_text(spark):
    rng = random.Random(3)
    a, b, c = (" ".join("w%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, a + " x"), (4, b), (5, c), (6, "few words"), (6, None)]
    got = sorted(tuple(r) for r in grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {(i, k) for i, _, k in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)} and len(got) == len(rows)
    assert [n for i, n, _ in got if i == 6] == [0, 1]


def test_suffix_dedup_judges_every_text(spark):
    rng = random.Random(9)
    p, q = ("".join(rng.choice("abcdefghij klmnop") for _ in range(300)) for _ in range(2))
    rows = [(1, p), (2, "short"), (2, "zz" + p), (3, p[:200] + q), (3, "?" + q), (4, q)]
    got = {}
    for r in digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert got[1] == [(300, 0)] and sorted(got[2]) == [(5, 0), (302, 300)] and got[4] == [(300, 300)]
    # of the texts of 3 the one with the smaller digest comes first
    assert sorted(got[3]) in ([(301, 0), (500, 500)], [(301, 300), (500, 200)])


def test_near_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.02]), (4, [0.0, 0.0, 1.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True),
    ]


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) * 10 ** rng.integers(0, 9)).tolist()) for i in range(60)]
    rows += [(100, [9e6, 0.0, 0.0, 0.0]), (101, [9e6, 1.0, 0.0, 0.0]), (150, [1.0, 2.0, 3.0, 4.0])]
    ints = {i: [int(np.floor(np.float64(256 * x))) for x in v] for i, v in rows}
    want = []
    for q in ints:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q))[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = {q for q, _, _, s in want if abs(s) >= 2**63}
    if not small:
        assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)
    with pytest.raises(Exception, match="does not fit in a long"):
        top_k(spark.createDataFrame([(0, [4e8] * 4), (1, [4e8] * 4)], df.schema), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="62 bits"):
        top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], df.schema), F.col("vec_id") == 0).collect()


def test_more_languages_than_the_embedding_is_wide(spark):
    rng = random.Random(1)
    stems = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(300)}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(30))) for lang, w in stems.items() for _ in range(8)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = train(df, F.rand(1), epochs=30)
    assert len(model.languages) == 300
    got = predict(df, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9 and len({r["lang_pred"] for r in got}) > 270


def test_workers_need_no_installed_package(tmp_path):
    """The session starts elsewhere and without a path to the package, as on a cluster."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from __spark_entry__ import queries
from provspark.session import build_session
spark = build_session("elsewhere", "4")
for name, fn in queries().items():
    if name.startswith("op") or name == "pipeline":
        fn(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
def missing(batches):
    import pandas as pd
    try:
        import provspark
        yield pd.DataFrame({{"found": [1]}})
    except ModuleNotFoundError:
        yield pd.DataFrame({{"found": [0]}})
missing.__module__ = "__main__"
assert spark.range(1).mapInPandas(missing, "found int").first()[0] == 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(ran) == 14 and "pipeline" in ran
