"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_batches, pieces, tidied, utf8
from provspark.llm.words import letters
from provspark.session import settle

#: Bytes of a subword, buckets of each length, width of an embedding.
SIZES, BUCKETS, WIDTH = (3, 4), 1 << 14, 16
#: Bound of the training sample: rows of each language (about), however many languages there are.
PER_LANGUAGE = 1500
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    subword: np.ndarray  # per bucket its embedding, or where that is no wider, the logits that it adds
    weight: np.ndarray | None  # softmax weights of the embedding; None where subwords have logits
    bias: np.ndarray
    temperature: float
    least: float  # predictions with a lower score are rejected


def subwords(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of every window of bytes, and whether it counts.

    A window counts if it stays in one document and only its first and last byte may be no letter.
    """
    form = letters()[raw]
    code = form.astype(np.uint32)
    gap = form == 0
    for k, size in enumerate(SIZES):
        n = len(raw) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int32), np.zeros(0, bool)
            continue
        value = code[:n].copy()
        for i in range(1, size):
            value = value << np.uint32(8) | code[i : n + i]
        value = (value * np.uint32(2654435769)) >> np.uint32(32 - 14)
        good = np.ones(n, bool)
        for i in range(1, size - 1):
            good &= ~gap[i : n + i]
        for i in range(1, size):
            at = offsets[1:-1] - i
            good[at[(at >= 0) & (at < n)]] = False
        yield value.astype(np.int32) + k * BUCKETS, good


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        raw, offsets = utf8(batch.column("text"))
        found = list(subwords(raw, offsets))
        buckets, counts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = np.concatenate([v[a:b][g[a:b]] for v, g in found])
            value, count = np.unique(own, return_counts=True)
            buckets.append(value.astype(np.int32))
            counts.append(count.astype(np.int32))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(buckets, kind), pa.array(counts, kind)], ["lang", "buckets", "counts"]
        )


def train(known: DataFrame, draw: Column, seed: int = 7, epochs: int = 6, rate: float = 2.0, accurate: float = 0.99) -> Model:
    """Fits on a bounded sample of ``known`` (text, lang): every row whose ``draw`` (uniform, 0 to 1) is small enough.

    A fifth of the sample is kept from training: it gives the temperature of the scores and the least score at which
    predictions are right with a frequency of ``accurate``.
    """
    bounded_batches(known.sparkSession)
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", draw.alias("draw"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # none is left out
    if not languages:
        return Model([UNKNOWN], np.zeros((len(SIZES) * BUCKETS, 1), np.float32), None, np.zeros(1, np.float32), 1.0, 1.0)
    sizes = settle(known.groupBy("lang").agg(F.count("*").alias("n")))
    chosen = known.join(sizes, "lang").where(F.col("draw") * F.col("n") < PER_LANGUAGE)
    sample = chosen.select("text", "lang").mapInArrow(tidied(_counts), "lang string, buckets array<int>, counts array<int>")
    rows = sorted(((r["lang"], r["buckets"], r["counts"]) for r in sample.toLocalIterator()), key=lambda r: (r[0], len(r[1]), r[1]))
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number[r[0]] for r in rows])
    docs = [(np.array(r[1], np.int64), np.array(r[2], np.float32)) for r in rows]
    docs = [(b, c / max(c.sum(), 1)) for b, c in docs]
    order = np.random.default_rng(seed).permutation(len(docs))
    kept = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    embed, weight, bias = _descend([docs[i] for i in fit], label[fit], len(languages), seed, epochs, rate)
    table, weight = ((embed @ weight).astype(np.float32), None) if len(languages) <= WIDTH else (embed, weight)
    hidden = np.array([(table[b] * c[:, None]).sum(axis=0) for b, c in (docs[i] for i in kept)]).reshape(len(kept), -1)
    logits = (hidden if weight is None else hidden @ weight) + bias if len(kept) else np.zeros((0, len(languages)))
    temperature, least = _calibrate(logits, label[kept], accurate)
    return Model(languages, table, weight, bias.astype(np.float32), temperature, least)


def _descend(docs, label, n_labels, seed, epochs, rate):
    """Stochastic gradient descent in batches, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (len(SIZES) * BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = rng.normal(0, 0.5, (WIDTH, n_labels)).astype(np.float32), np.zeros(n_labels, np.float32)
    size, total, done = 16, epochs * len(docs), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), size):
            part = order[a : a + size]
            length = [len(docs[i][0]) for i in part]
            row = np.repeat(np.arange(len(part)), length)
            bucket = np.concatenate([docs[i][0] for i in part])
            share = np.concatenate([docs[i][1] for i in part])
            hidden = np.zeros((len(part), WIDTH), np.float32)
            np.add.at(hidden, row, embed[bucket] * share[:, None])
            p = softmax(hidden @ weight + bias)
            p[np.arange(len(part)), label[part]] -= 1
            p /= len(part)
            back = p @ weight.T
            step = rate * (1 - done / total)
            weight -= step * hidden.T @ p
            bias -= step * p.sum(axis=0)
            np.add.at(embed, bucket, -step * 20 * share[:, None] * back[row])
            done += len(part)
    return embed, weight, bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _calibrate(logits: np.ndarray, label: np.ndarray, accurate: float) -> tuple[float, float]:
    if not len(label):
        return 1.0, 0.0
    grid = np.geomspace(0.1, 10, 60)
    rows = np.arange(len(label))
    loss = [-np.log(softmax(logits / t)[rows, label] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == label[order]) / (rows + 1)
    enough = np.flatnonzero(right >= accurate)
    return temperature, float(p.max(axis=1)[order][enough[-1]]) if len(enough) else 1.0


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` (score below the calibrated least, or unknown).

    Null texts and texts without a letter are ``und`` with score 0. The whole text is read. Columns of ``docs`` with the
    names of the new ones are replaced.
    """
    parts = (model.languages, model.subword, model.weight, model.bias, model.temperature)
    held = docs.sparkSession.sparkContext.broadcast(parts)  # buckets x WIDTH, and WIDTH x languages
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, subword, weight, bias, temperature = held.value
        for batch in pieces(batches, text, 1 << 20):
            raw, offsets = utf8(batch.column(text))
            total = np.zeros((batch.num_rows, subword.shape[1]))
            number = np.zeros(batch.num_rows)
            for bucket, good in subwords(raw, offsets):
                keep = np.flatnonzero(good)
                ends = np.searchsorted(keep, offsets)
                some = ends[1:] > ends[:-1]
                if some.any():
                    total[some] += np.add.reduceat(subword[bucket[keep]], ends[:-1][some], axis=0)
                number += np.diff(ends)
            mean = total / np.maximum(number, 1)[:, None]
            p = softmax(((mean if weight is None else mean @ weight) + bias) / temperature)
            best = p.argmax(axis=1)
            names = pa.array([languages[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), names, pa.array(p[np.arange(len(best)), best])], [*rest, "lang_pred", "score"]
            )

    chosen = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = chosen.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return chosen.mapInArrow(tidied(run), schema).withColumns({
        "lang_pred": F.when(readable, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(readable, F.col("score")).otherwise(0.0),
        "rejected": ~readable | (F.col("score") < model.least),
    })
