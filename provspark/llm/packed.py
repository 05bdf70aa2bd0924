"""Sorted 64-bit columns in blobs that compress well on their way through a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from provspark.llm.common import U64, blobs, mix

SCHEMA = "part int, kind int, a binary, b binary, c binary, d binary"


def planes(x: np.ndarray) -> bytes:
    """64-bit values byte by byte of the same rank: runs of alike high bytes compress."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def deltas(x: np.ndarray) -> bytes:
    """Sorted unsigned values as planes of their differences."""
    return planes(np.diff(x, prepend=U64(0)).view(np.int64))


def undeltas(raw: bytes | memoryview) -> np.ndarray:
    return np.cumsum(unplanes(raw).view(U64))


def rows(out: list[tuple]) -> pa.RecordBatch:
    """Tuples (part, kind, up to four blobs) as a batch of ``SCHEMA``."""
    filled = [(*r, *[b""] * (6 - len(r))) for r in out]
    part, kind, *rest = zip(*filled, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *(blobs([bytes(b) for b in x]) for x in rest)],
        ["part", "kind", "a", "b", "c", "d"],
    )


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``SCHEMA`` one by one, each blob a view of its batch."""
    for batch in batches:
        part, kind = batch.column("part").to_pylist(), batch.column("kind").to_pylist()
        rest = [batch.column(c) for c in "abcd"]
        for i, (p, k) in enumerate(zip(part, kind, strict=True)):
            yield p, k, *(memoryview(c[i].as_buffer()) for c in rest)


def starts(n: int) -> np.ndarray:
    """Where n equal ranges of 64-bit hashes begin."""
    return np.array([(i << 64) // n for i in range(n)], U64)


def owner(doc: np.ndarray, n: int) -> np.ndarray:
    """Part of a document."""
    return (mix(doc.view(U64)) % U64(n)).astype(np.int64)


def by_owner(kind: int, n_parts: int, doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Blobs of columns, dealt by document."""
    part = owner(doc, n_parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        i = order[cuts[p] : cuts[p + 1]]
        yield (int(p), kind, planes(doc[i]), *(planes(c[i]) for c in columns))
