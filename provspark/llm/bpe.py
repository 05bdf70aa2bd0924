"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import blobs, bounded_batches, lists, pieces, tidied

NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices; a longer match is merged alone, with a heap.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Cells of one matrix, and matches kept with their ids in a task: bounds of its memory, without effect on results.
CELLS, KEPT = 2_000_000, 200_000


@dataclass
class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of them that joins to another, in an open-addressed table."""

    tokens: list[bytes]
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of base64 token and rank per line. The file has a fixed size, so it may be broadcast."""
        with open(path, "rb") as f:
            of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(of.values()) + 1)
        for token, rank in of.items():
            tokens[rank] = token
        pairs = {}
        for token, rank in of.items():
            for cut in range(1, len(token)):
                left, right = of.get(token[:cut]), of.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        size = 1 << (4 * len(pairs)).bit_length()
        keys, ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = slot(todo, size)
        while len(todo):
            free = keys[at] == -1
            keys[at[free]] = todo[free]  # of several for one slot the last stays
            placed = keys[at] == todo
            ranks[at[placed]] = rank[placed]
            todo, rank, at = todo[~placed], rank[~placed], (at[~placed] + 1) & (size - 1)
        return cls(tokens, keys, ranks)

    def plain(self) -> tuple:
        """Its parts, which workers can read without this module."""
        return self.tokens, self.keys, self.ranks

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or NONE; a negative id joins with nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        flat = key.ravel()
        out = np.full(len(flat), NONE, np.int32)
        live = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = slot(flat[live], len(self.keys))
        while len(live):
            found = self.keys[at]
            hit = found == flat[live]
            out[live[hit]] = self.ranks[at[hit]]
            on = ~hit & (found != -1)
            live, at = live[on], (at[on] + 1) & (len(self.keys) - 1)
        return out.reshape(key.shape)


def slot(key: np.ndarray, size: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


class Encoder:
    """Ids of matches of the pattern, kept for matches seen before."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.whole = {token: rank for rank, token in enumerate(vocabulary.tokens) if token}
        self.bytes = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self.kept: dict[str, bytes] = {}

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as 32-bit integers."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = {w for row in words for w in row}.difference(self.kept)
        self.learn(sorted(new, key=len))
        kept = self.kept
        return [b"".join([kept[w] for w in row]) for row in words]

    def column(self, texts: pa.Array) -> pa.ListArray:
        rows = self.documents(texts.to_pylist())
        count = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
        return lists(np.frombuffer(b"".join(rows), np.int32), count, pa.int32())

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        bucket = np.searchsorted(WIDTHS, size)
        for k in np.unique(bucket):
            rows = np.flatnonzero(bucket == k)
            if k == len(WIDTHS):
                for i in rows:
                    self.kept[words[i]] = self.alone(raw[i])
                continue
            step = max(1, CELLS // WIDTHS[k])
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                ids, n = self.merge([raw[i] for i in part], WIDTHS[k])
                for j, i in enumerate(part):
                    rank = self.whole.get(raw[i])
                    self.kept[words[i]] = ids[j, : n[j]].tobytes() if rank is None else np.int32(rank).tobytes()

    def merge(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded ids and their number per row: each round merges the leftmost pair of least rank in every row."""
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(-1, width)
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        done = np.where(np.arange(width) < n[:, None], self.bytes[padded], np.int32(-1))
        live, ids = np.arange(len(raw)), done.copy()
        while len(live) and ids.shape[1] > 1:
            ranks = self.vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            on = best != NONE
            ended = live[~on]
            done[ended, : ids.shape[1]] = ids[~on]
            live, ids, at, best = live[on], ids[on], at[on], best[on]
            if not len(live):
                break
            ids[np.arange(len(ids)), at] = best
            column = np.arange(ids.shape[1] - 1)  # compaction: what lies right of the pair moves one to the left
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            n[live] -= 1
        done[live, : ids.shape[1]] = ids
        return done, n

    def alone(self, raw: bytes) -> bytes:
        """The same merges of one long match: a heap of (rank, place) over a linked list."""
        if raw in self.whole:
            return np.int32(self.whole[raw]).tobytes()
        ids = self.bytes[np.frombuffer(raw, np.uint8)]
        first = self.vocabulary.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        rank_at = dict((i, r) for r, i in heap)
        end, tokens, whole = len(raw), self.vocabulary.tokens, self.whole

        def offer(i: int) -> None:
            rank_at.pop(i, None)
            if i >= 0 and after[i] < end:
                rank = whole.get(tokens[ids[i]] + tokens[ids[after[i]]])
                if rank is not None:
                    rank_at[i] = rank
                    heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at.get(i) != rank:
                continue
            gone = after[i]
            rank_at.pop(gone, None)
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < end:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()


def encode(df: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of ``df`` with a column of its token ids, as the rank file orders them.

    Null and empty texts have no ids; no text is cut, repeated rows are encoded alike, and there are no special tokens.
    A column that already has the name of the new one is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.plain())  # as large as the rank file, whatever the data
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value), pattern)
        for batch in pieces(batches, text, 1 << 20):
            column = encoder.column(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), column], [*rest, ids])

    schema = df.select(*(F.col(f"`{c}`") for c in rest), F.lit(None).cast("array<int>").alias(ids)).schema
    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(tidied(run), schema)


def _decoded(column: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return blobs([b"".join([tokens[t] for t in flat[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:], strict=True)])


def round_trip(
    df: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode``, then ``decode``, in one pass over the rows: one Python worker a task instead of two."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.plain())
    rest = [c for c in df.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(Vocabulary(*shared.value), pattern), Vocabulary(*shared.value).tokens
        for batch in pieces(batches, text, 1 << 20):
            column = encoder.column(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), column, _decoded(column, tokens)], [*rest, ids, decoded]
            )

    chosen = df.select(*(F.col(f"`{c}`") for c in rest))
    schema = chosen.withColumns({ids: F.lit(None).cast("array<int>"), decoded: F.lit(None).cast("binary")}).schema
    return chosen.mapInArrow(tidied(run), schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row of ``df`` with the bytes that its ids stand for: a gather from the joined bytes of all tokens.

    Null or no ids give no bytes; an id outside the vocabulary fails.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.plain())
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(*shared.value).tokens
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            out = _decoded(batch.column(ids), tokens)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), out], [*rest, decoded])

    schema = df.select(*(F.col(f"`{c}`") for c in rest), F.lit(None).cast("binary").alias(decoded)).schema
    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(tidied(run), schema)
