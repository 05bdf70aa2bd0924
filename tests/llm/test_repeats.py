import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provspark.llm import repeats
from provspark.llm.repeats import repeated_spans, without_spans
from provspark.llm.repeats_query import digests, op8


def plain(rows):
    seen, out = {}, {}
    for i, text in sorted((i, t or "") for i, t in rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            first = seen.setdefault(raw[p : p + 100], (i, p))
            if first != (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "id": F.lit(1), "kept": F.lit(2)})
    got = digests(df).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == plain({r for r in rows if r[0] is not None})


def test_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op8(spark, sf).collect()} == plain(rows)


@pytest.mark.parametrize("seed, held, chunk", [(0, 400_000, 1 << 20), (1, 50, 1 << 20), (2, 300, 700)])
def test_passages_copies_and_periods(spark, monkeypatch, seed, held, chunk):
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(seed)
    letters = "abcdefghij klmnop é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 130, 300, 900)]
    rows = []
    for i in range(60):
        parts = [text(rng.choice([0, 1, 50, 400]))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3)
            parts += [p[cut:] if rng.random() < 0.5 else p, text(rng.choice([0, 3, 120]))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(8)]  # copies
    rows += [(200, "ab" * 400), (201, "abab" * 30), (202, "x" * 1000), (203, "x" * 99), (204, "xy" + "x" * 120)]
    check(spark, rows)


def test_odd_rows(spark):
    p = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    rows = [(1, None), (2, ""), (3, "é" * 150), (4, p), (5, "zz" + p[50:260] + "qq"), (5, "zz" + p[50:260] + "qq"), (6, p[:99]), (7, p[:100])]
    check(spark, [*rows, (None, p)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(df.limit(0)).collect() == [] and repeated_spans(df.limit(0)).collect() == []
    assert [tuple(r) for r in digests(spark.createDataFrame([(None, p)], df.schema)).collect()][0][:4] == (None, 400, 0, 0)


def test_whole_characters_are_kept(spark):
    p = "é" * 25 + "abcdefghij" * 8 + "ü" * 30
    rows = [(1, "1" + p + "2"), (2, "xä" + p + "öy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = without_spans(df, repeated_spans(df), whole=True).where("doc_id = 2").first()
    bytes(out["kept"]).decode()  # UTF-8
