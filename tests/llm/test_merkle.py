import hashlib
import random
import zlib

import pytest

from provspark.llm.merkle import Manifest, address, build, fold, height_of, layout, leaf_of, levels_of, nodes_of, positions, siblings
from provspark.llm.merkle_query import op12, proven


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda d: (d[0] is None, d[0] or 0, leaf(*d)))
    trees = {s: tree([leaf(*d) for d in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names]) if names else None
    out = []
    for n, s in enumerate(names):
        for i, d in enumerate(groups[s]):
            own = path(trees[s], i) + path(top, n)
            bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            now = leaf(*d[:4], d[4].replace("\n", "")) if bad else leaf(*d)
            for left, right in own:
                now = H(*left, now, *right)
            root = top[-1][0]
            out.append((d[0], leaf(*d), trees[s][-1][0], root, H(*(x for l, r in own for x in (*l, *r))), now, now == root))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_on_a_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = rows(op12(spark, sf))
    assert got == plain(docs) and {r[-1] for r in got} == {True, False}


def test_addresses_are_a_bijection_and_subtrees_lie_together():
    for levels in range(1, 8):
        n = nodes_of(levels)
        at = [address(levels, d, i) for d in range(levels) for i in range(3**d)]
        assert sorted(at) == list(range(n)) and at[0] == 0
    # seven levels: three above, then each of the 27 subtrees of four levels in one piece
    for i in range(27):
        below = [address(7, 3 + d, i * 3**d + j) for d in range(4) for j in range(3**d)]
        assert sorted(below) == list(range(13 + i * 40, 13 + (i + 1) * 40))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 242, 244, 729])
def test_block_equals_a_plain_tree(n):
    leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
    levels, height = tree([x.hex() for x in leaves]), height_of(n)
    nodes = layout(leaves, height)
    assert nodes[:32].hex() == levels[-1][0] and len(levels) == height + 1
    for i in {0, n // 2, n - 1}:
        own = siblings(nodes, n, height, i)
        assert [([x.hex() for x in a], [x.hex() for x in b]) for a, b in levels_of(own)] == path(levels, i)
        assert fold(leaves[i], own) == nodes[:32]


@pytest.mark.parametrize("height", [6, 1])
def test_groups_of_many_sizes_over_several_tiers(spark, monkeypatch, height):
    import provspark.llm.merkle as m

    monkeypatch.setattr(m, "HEIGHT", height)  # blocks of three leaves give many tiers
    rng = random.Random(height)
    docs = []
    for n, (s, size) in enumerate([(None, 5), ("", 1), ("a", 1), ("A", 3), ("é", 28), ("zz", 90), ("big", 900), ("=", 10)]):
        docs += [(n * 1000 + i if rng.random() < 0.9 else -i, s, rng.choice(["en", None]), rng.choice([None, i]), "line\n" * (i % 3)) for i in range(size)]
    docs += [(None, "zz", None, None, None), (None, "zz", "en", 1, "x\ny"), (7, "zz", "en", 1, ""), (7, "zz", "en", 1, ""), (7, "zz", "en", 1, "other\n"),
             (2**60, "big", "en", 3, "é\n" * 100_000), (2**60 + 1, "big", "en", 3, None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(proven(df)) == plain(docs)


def test_one_source_one_document_and_no_documents(spark):
    one = [(1, "s", "en", 3, "abc")]
    assert rows(proven(spark.createDataFrame(one, SCHEMA))) == plain(one)
    none = spark.createDataFrame([], SCHEMA)
    assert proven(none).collect() == []
    leaves = none.select("doc_id", "source", leaf_of(none["text"]).alias("leaf"))
    assert Manifest(leaves).root is None


def test_positions_and_blocks(spark):
    df = spark.range(2000).selectExpr("concat('=', cast(id % 3 as string)) AS grp", "id * 7 % 2000 AS k", "unhex(sha2(cast(id as string), 256)) AS leaf")
    got = positions(df, [df["k"]]).collect()
    for g in {r["grp"] for r in got}:
        own = sorted((r for r in got if r["grp"] == g), key=lambda r: r["k"])
        assert [r["pos"] for r in own] == list(range(len(own))) and {r["total"] for r in own} == {len(own)}
    tiers = build(positions(df, [df["k"]]))
    assert len(tiers) == 1 and tiers[0].count() == 3  # 667 leaves fit in a block
    assert all(len(r["nodes"]) == 32 * nodes_of(7) for r in tiers[0].collect())
