"""Vectors in ARRAY columns: centring, block slices, hashes, logistic scores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once; a column used inside a lambda would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scaled_to_unit(values: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return let(norm(values), lambda n: F.when(n > 0, F.transform(values, lambda x: x.cast("double") / n)))


def thumb_vector(values: Column, damping: float = 0.0) -> Column:
    """Mean-centred unit vector. Without damping a flat input (norm at most 1e-3) gives null."""

    def shrink(centred: Column) -> Column:
        def divide(length: Column) -> Column:
            unit = F.transform(centred, lambda x: x / (length + F.lit(damping)))
            return unit if damping else F.when(length > 1e-3, unit)

        return let(norm(centred), divide)

    centre = let(_total(values) / F.size(values), lambda m: F.transform(values, lambda x: x.cast("double") - m))
    return let(centre, shrink)


def dhash(values: Column, width: int = 9, height: int = 8) -> Column:
    """Signs of the differences between neighbours in each row, first bit highest, as one 64-bit number."""
    places = [r * width + c for r in range(height) for c in range(width - 1)]
    bits = F.transform(
        F.array(*[F.lit(p) for p in places]),
        lambda p: (F.get(values, p + 1) > F.get(values, p)).cast("bigint"),
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def select_blocks(vec: Column, order: Sequence[str], dims: Mapping[str, int], wanted: Sequence[str]) -> Column:
    """Blocks of the wanted backbones out of a concatenated vector; a vector of exactly their width passes through."""
    starts, at = {}, 1
    for name in order:
        starts[name] = at
        at += dims[name]
    need = sum(dims[n] for n in wanted)
    reach = max(starts[n] + dims[n] - 1 for n in wanted)
    picked = F.concat(*[F.slice(vec, starts[n], dims[n]) for n in wanted])
    missing = F.raise_error(F.concat(F.lit(f"vector too short for {list(wanted)}: "), F.size(vec).cast("string")))
    return F.when(F.size(vec) == need, vec).when(F.size(vec) >= reach, picked).otherwise(missing)


def standardise(vec: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(
        F.zip_with(vec, mean, lambda x, m: x.cast("double") - m), scale, lambda x, s: x / s
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def _trigram_counts(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    grams = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 1024 if len(c) >= 3 else np.zeros(0, dtype=np.int64)
    return np.bincount(grams, minlength=1024).astype(np.float64)


def _text_thumbs(text: pd.Series) -> pd.Series:
    def thumb(t: str | None):
        if t is None:
            return None
        v = _trigram_counts(t)
        v -= v.mean()
        length = np.linalg.norm(v)
        return v / length if length > 1e-3 else None

    return text.map(thumb)


def text_thumb(text: Column) -> Column:
    """Mean-centred unit vector of the hashed character trigrams of the whole text (1,024 bins); null when flat."""
    return F.pandas_udf(_text_thumbs, "array<double>")(text)


BINS = 1024


def pack_counts(counts: np.ndarray) -> list[bytes]:
    """Rows of whole counts as the bytes that a count takes (1, 2 or 4), one bit for each bin, and the nonzero counts."""
    bits = np.packbits(counts > 0, axis=1)
    width = np.where(counts.max(axis=1, initial=0) < 1 << 8, 1, np.where(counts.max(axis=1, initial=0) < 1 << 16, 2, 4))
    return [bytes([w]) + m.tobytes() + row[row > 0].astype(f"<u{w}").tobytes() for w, m, row in zip(width, bits, counts, strict=True)]


def unpack_units(packed: Sequence[bytes]) -> np.ndarray:
    """Mean-centred unit vectors of ``BINS`` components from packed counts."""
    out, head = np.zeros((len(packed), BINS)), 1 + BINS // 8
    if len(packed):
        bits = np.frombuffer(b"".join(raw[1:head] for raw in packed), np.uint8).reshape(len(packed), -1)
        out[np.unpackbits(bits, axis=1).view(bool)] = np.concatenate([np.frombuffer(raw, f"<u{raw[0]}", -1, head) for raw in packed])
    return _centred(out)[0]


def _centred(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred unit rows, in place, and the lengths that they had."""
    counts -= counts.mean(axis=1, keepdims=True)
    length = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    counts /= np.maximum(length, 1e-300)[:, None]
    return counts, length


def _short_runs(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of at most ``rows``, and of ``most`` characters unless one text alone is longer."""
    size = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and (i - start == rows or total + n > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield batch.slice(start)


def packed_trigrams(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, vec, digest): hashed character trigrams of whole texts as packed counts, and a digest of the unit
    vector that they stand for; null and flat texts drop."""
    for batch in batches:
        for part in _short_runs(batch.filter(pc.is_valid(batch.column("text"))), rows, most):
            texts = part.column("text").to_pylist()
            c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
            size = np.array([len(t) for t in texts], np.int64)
            doc = np.repeat(np.arange(len(texts)), size)
            inside = doc[2:] == doc[:-2]  # no trigram reaches over the end of a text
            grams = (c[:-2] * 961 + c[1:-1] * 31 + c[2:])[inside] % BINS
            counts = np.bincount(doc[:-2][inside] * BINS + grams, minlength=len(texts) * BINS).reshape(len(texts), BINS)
            units, length = _centred(counts.astype(np.float64))
            kept = np.flatnonzero(length > 1e-3)
            digest = [hashlib.blake2b((units[i] + 0.0).tobytes(), digest_size=16).digest() for i in kept]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(kept)), pa.array(pack_counts(counts[kept]), pa.binary()), pa.array(digest, pa.binary())],
                ["id", "vec", "digest"],
            )
