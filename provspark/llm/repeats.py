"""Repeated passages by prefix doubling over a suffix order that is thinned to anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, blobs, bounded_batches, lists, mix, parts, pieces, release, text_digest, tidied, utf8, with_nodes
from provspark.llm.packed import SCHEMA, by_owner, deltas, entries, planes, rows, starts, undeltas, unplanes
from provspark.llm.words import prefix_sums, span_hash
from provspark.session import cut_lineage

#: Bytes of a string that may not repeat, of the first and of the second rank, and how far apart two second ranks lie.
LENGTH, FIRST, SECOND = 100, 32, 64
SHIFT = LENGTH - SECOND
#: Bytes of a text that are ranked at once, and entries that a task holds before it hands them on.
CHUNK, HELD = 1 << 20, 150_000
#: Ranges of ranks for each of the session's shuffle partitions: a task sorts one at a time.
RANGES = 2
#: Kinds of packed rows.
RUN, SPAN, OPEN = 0, 1, 2
BY_DOCUMENT = "id long, start array<bigint>, end array<bigint>, at array<bigint>, more array<bigint>"


def runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of ``LENGTH`` bytes with one anchor, inside the given stretches of ``raw``.

    The anchor of a window is the leftmost of its ``FIRST``-byte strings with the least hash, so equal windows have it
    at the same place. Returned per run: stretch, first and last window, hash of the anchor, hash of all its bytes and
    of where the anchor stands.
    """
    n = len(raw) - FIRST + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if len(raw) < LENGTH:
        return none
    sums = prefix_sums(raw)
    at = np.arange(n)
    key = (span_hash(sums, at, at + FIRST) >> U64(28) << U64(28)) | at.astype(U64)
    width, low = 1, key
    span = LENGTH - FIRST + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(raw) - LENGTH + 1], low[span - width :][: len(raw) - LENGTH + 1])
    anchor = (low & U64((1 << 28) - 1)).astype(np.int64)
    stretch = np.full(len(anchor), -1)
    for k in np.flatnonzero(end - start >= LENGTH):
        stretch[start[k] : end[k] - LENGTH + 1] = k
    edge = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(stretch, prepend=-2) != 0))
    last = np.append(edge[1:], len(anchor)) - 1
    good = stretch[edge] >= 0
    first, last = edge[good], last[good]
    a = anchor[first]
    inner = mix(span_hash(sums, a, a + FIRST))  # mixed anew: hashes of anchors are small ones
    whole = mix(span_hash(sums, first, last + LENGTH) ^ ((a - first).astype(U64) * U64(0xA24BAED4963EE407)))
    return stretch[first], first, last, inner, whole


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, document, place of the first byte in it); a long text comes in chunks that share windows' ends."""
    raw, offsets = utf8(batch.column("text"))
    ids = batch.column("id").to_numpy()
    if len(raw) <= 2 * CHUNK:
        yield raw, offsets[:-1], offsets[1:], ids, np.zeros(len(ids), np.int64)
        return
    for k, doc in enumerate(ids):
        for a in range(int(offsets[k]), int(offsets[k + 1]), CHUNK):
            part = raw[a : min(a + CHUNK + LENGTH - 1, int(offsets[k + 1]))]
            yield part, np.array([0]), np.array([len(part)]), np.array([doc]), np.array([a - offsets[k]])


def _rank_runs(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in pieces(batches, "text", CHUNK // 4):
        for raw, start, end, ids, base in _stretches(batch):
            k, first, last, inner, whole = runs(raw, start, end)
            if len(k):
                held.append((inner, whole, ids[k], first - start[k] + base[k], last - first))
                size += len(k)
        if size >= HELD:
            yield rows(list(_deal_runs(held, n_parts)))
            held, size = [], 0
    if size:
        yield rows(list(_deal_runs(held, n_parts)))


def _deal_runs(held: list[tuple[np.ndarray, ...]], n_parts: int) -> Iterator[tuple]:
    """Runs whose like the task has seen before are settled here; the others go to the range of their anchor."""
    inner, whole, doc, at, more = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, doc, whole, inner))
    inner, whole, doc, at, more = (x[order] for x in (inner, whole, doc, at, more))
    later = _later(doc, at, inner, whole)
    yield from by_owner(SPAN, n_parts // RANGES, *_spans(doc[later], at[later], at[later] + more[later] + LENGTH))
    inner, whole, doc, at, more = (x[~later] for x in (inner, whole, doc, at, more))
    cuts = np.append(np.searchsorted(inner, starts(n_parts)), len(inner))
    for p in np.flatnonzero(np.diff(cuts)):
        i = slice(cuts[p], cuts[p + 1])
        yield int(p), RUN, deltas(inner[i]), planes(whole[i].view(np.int64)), planes(doc[i]), planes(at[i] << 8 | more[i])


def _first(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _later(doc: np.ndarray, at: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Of rows sorted by (key, doc, at), those with an earlier place of the same key; a repeated row is at one place."""
    new = _first(*key)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[head]) | (at != at[head])


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches that the given ones cover, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = _first(doc)
    # furthest end so far within a document, by adding an offset that grows from one document to the next
    group = np.cumsum(new) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    new[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], start[head], reach[np.append(head[1:], len(doc)) - 1]


def _settle_runs(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """In a range of anchors: a run like an earlier one is a repeat; unlike runs with one anchor stay open."""
    by_part: dict[int, list] = {}
    for part, kind, a, b, c, d in entries(batches):
        if kind == SPAN:
            yield rows([(part, SPAN, a, b, c)])
        else:
            by_part.setdefault(part, []).append((undeltas(a), unplanes(b).view(U64), unplanes(c), unplanes(d)))
    settled, still_open = [], []
    for part in list(by_part):
        inner, whole, doc, at = (np.concatenate(x) for x in zip(*by_part.pop(part), strict=True))
        order = np.lexsort((at, doc, whole, inner))
        inner, whole, doc, at = (x[order] for x in (inner, whole, doc, at))
        more, at = at & 255, at >> 8
        later = _later(doc, at, inner, whole)
        group = np.cumsum(_first(inner)) - 1
        kinds = np.bincount(group, weights=_first(inner, whole))[group] if len(group) else np.zeros(0)
        settled.append(_spans(doc[later], at[later], at[later] + more[later] + LENGTH))
        still = ~later & (kinds > 1)
        still_open.append((doc[still], at[still], more[still]))
    yield from _handed_on(n_parts, settled, still_open)


def _handed_on(n_parts: int, settled: list[tuple], still_open: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What a task has found in all its ranges, once for each part of documents."""
    out = []
    for kind, found in ((SPAN, settled), (OPEN, still_open)):
        if found:
            out += by_owner(kind, n_parts // RANGES, *(np.concatenate(x) for x in zip(*found, strict=True)))
    if out:
        yield rows(out)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its settled spans and open runs."""
    settled, still = [], []
    for _, kind, a, b, c, _ in entries(batches):
        (settled if kind == SPAN else still).append((unplanes(a), unplanes(b), unplanes(c)))
    empty = [np.zeros(0, np.int64)] * 3
    doc, start, end = _spans(*(np.concatenate(x) for x in zip(*(settled or [empty]), strict=True)))
    own, at, more = (np.concatenate(x) for x in zip(*(still or [empty]), strict=True))
    order = np.lexsort((at, own))
    own, at, more = own[order], at[order], more[order]
    ids = np.unique(np.concatenate([doc, own]))
    n, m = (np.searchsorted(x, ids, side="right") - np.searchsorted(x, ids) for x in (doc, own))
    if len(ids):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), *(lists(x, n, pa.int64()) for x in (start, end)), *(lists(x, m, pa.int64()) for x in (at, more))],
            ["id", "start", "end", "at", "more"],
        )


def _rank_windows(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Windows of open runs with the pair of ranks of their first and last ``SECOND`` bytes, by ranges of the first."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        texts = batch.column("text")
        for i, (doc, at, more) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "at", "more")), strict=True)):
            raw = np.frombuffer(texts[i].as_py().encode(), np.uint8)
            at, more = np.array(at, np.int64), np.array(more, np.int64)
            for a in range(0, len(at), 4096):
                held.append(_windows(raw, doc, at[a : a + 4096], more[a : a + 4096]))
                size += len(held[-1][0])
                if size >= HELD:
                    yield rows(list(_deal_windows(held, n_parts)))
                    held, size = [], 0
    if size:
        yield rows(list(_deal_windows(held, n_parts)))


def _windows(raw: np.ndarray, doc: int, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    length = more + LENGTH  # bytes of each run, laid end to end
    base = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(base - at, length)
    sums = prefix_sums(raw[place])
    n = more + 1
    first = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = span_hash(sums, first, first + SECOND)
    right = span_hash(sums, first + SHIFT, first + SHIFT + SECOND) >> U64(32)  # 96 bits tell windows apart
    return left, right, np.full(len(first), doc), place[first]


def _deal_windows(held: list[tuple[np.ndarray, ...]], n_parts: int) -> Iterator[tuple]:
    left, right, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, doc, right, left))
    left, right, doc, at = (x[order] for x in (left, right, doc, at))
    later = _later(doc, at, left, right)
    yield from by_owner(SPAN, n_parts // RANGES, *_spans(doc[later], at[later], at[later] + LENGTH))
    left, right, doc, at = (x[~later] for x in (left, right, doc, at))
    cuts = np.append(np.searchsorted(left, starts(n_parts)), len(left))
    for p in np.flatnonzero(np.diff(cuts)):
        i = slice(cuts[p], cuts[p + 1])
        yield int(p), RUN, deltas(left[i]), planes(right[i].view(np.int64)), planes(doc[i]), planes(at[i])


def _settle_windows(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Of equal windows all but the first are repeats."""
    by_part: dict[int, list] = {}
    for part, kind, a, b, c, d in entries(batches):
        if kind == SPAN:
            yield rows([(part, SPAN, a, b, c)])
        else:
            by_part.setdefault(part, []).append((undeltas(a), unplanes(b).view(U64), unplanes(c), unplanes(d)))
    settled = []
    for part in list(by_part):
        left, right, doc, at = (np.concatenate(x) for x in zip(*by_part.pop(part), strict=True))
        order = np.lexsort((at, doc, right, left))
        left, right, doc, at = (x[order] for x in (left, right, doc, at))
        later = _later(doc, at, left, right)
        settled.append(_spans(doc[later], at[later], at[later] + LENGTH))
    yield from _handed_on(n_parts, settled, [])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, start, end): per document with repeats its maximal spans of bytes that a ``LENGTH``-byte string covers which
    starts earlier too, in a smaller id or further left in the same text.

    Strings are bytes of UTF-8 and end with their document. Texts that are null or shorter than ``LENGTH`` have no spans.
    Rows that repeat an id and text are one document and get the same spans; rows without an id take no part. Ids are
    longs. Unlike texts of one id are documents of their own, in order of their sha256, which ``digest`` then holds; it is
    null where an id has one text.

    Ranks double from ``FIRST`` over ``SECOND`` to ``LENGTH`` bytes. The first are ranked at anchors only (each window has
    one, chosen by its content, about one place in 35): sorted by (rank of the anchor, rank of the run of windows around
    it, place), runs whose anchor is unique end, as do those that repeat a whole run. What is left, the runs at the edges
    of repeats, goes on with all its windows, sorted by the pair of ranks at offset ``SHIFT``. Equal keys that a task
    sees more than once leave it once, so a passage in very many documents is one row per task.
    """
    spans = _repeated_spans(docs, id_col, text)
    release(docs.sparkSession)
    return spans


def _repeated_spans(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    n_parts = RANGES * parts(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")

    source, bits = with_nodes(source, text_digest())
    named = source
    source = source.select(F.col("node").alias("id"), "text")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(n_parts // RANGES, "part")

    ranked = source.where(F.octet_length("text") >= LENGTH).mapInArrow(tidied(lambda b: _rank_runs(b, n_parts)), SCHEMA)
    settled = dealt(ranked).mapInArrow(tidied(lambda b: _settle_runs(b, n_parts)), SCHEMA)
    found = cut_lineage(dealt(settled).mapInArrow(tidied(_by_document), BY_DOCUMENT))
    del ranked, settled
    release(docs.sparkSession)
    still = found.where(F.size("at") > 0).select("id", "at", "more")
    windows = source.join(still, "id").mapInArrow(tidied(lambda b: _rank_windows(b, n_parts)), SCHEMA)
    late = dealt(windows).mapInArrow(tidied(lambda b: _settle_windows(b, n_parts)), SCHEMA)
    known = found.where(F.size("start") > 0).select("id", "start", "end")
    known = known.mapInArrow(tidied(lambda b: _as_blobs(b, n_parts)), SCHEMA)
    spans = dealt(late.unionByName(known)).mapInArrow(tidied(_by_document), BY_DOCUMENT)
    spans = cut_lineage(spans.select("id", "start", "end"))
    none = F.lit(None).cast("string").alias("digest")
    if not bits:
        return spans.select("id", none, "start", "end")
    names = named.select(F.col("node").alias("id"), text_digest().alias("digest")).distinct()
    return cut_lineage(spans.join(names, "id").select(F.shiftright("id", bits).alias("id"), "digest", "start", "end"))


def _as_blobs(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = batch.column("start")
        count = np.diff(start.offsets.to_numpy())
        doc = np.repeat(batch.column("id").to_numpy(), count)
        flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("start", "end")]
        out = list(by_owner(SPAN, n_parts // RANGES, doc, *flat))
        if out:
            yield rows(out)


def without_spans(
    docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text", kept: str = "kept", whole: bool = False
) -> DataFrame:
    """Every row of ``docs`` with its spans (``start``, ``end``) and the bytes outside of them as ``kept``.

    ``whole``: a character that a span covers in part is kept, so that the rest is UTF-8. Columns of ``docs`` with the
    names of the new ones are replaced. Null texts keep no bytes.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("start", "end", kept)]
    mine = docs.select(*(F.col(f"`{c}`") for c in rest))
    s = spans.select(F.col("id").alias("_span_id"), F.col("digest").alias("_span_digest"), "start", "end")
    own_text = F.col("_span_digest").isNull() | (F.col("_span_digest") == F.sha2(F.coalesce(mine[text], F.lit("")), 256))
    met = mine.join(s, (mine[id_col].cast("long") == s["_span_id"]) & own_text, "left").drop("_span_id", "_span_digest")
    schema = met.withColumn(kept, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, CHUNK):
            raw, offsets = utf8(batch.column(text))
            out = []
            for i, (a, b) in enumerate(zip(batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True)):
                own = raw[offsets[i] : offsets[i + 1]]
                out.append(_outside(own, a, b, whole) if a else own.tobytes())
            yield batch.append_column(kept, blobs(out))

    return met.mapInArrow(tidied(run), schema)


def _outside(own: np.ndarray, start: list[int], end: list[int], whole: bool) -> bytes:
    keep, last = [], 0
    for a, b in zip(start, end, strict=True):
        if whole:
            while a < b and own[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(own) and own[b] & 0xC0 == 0x80:
                b -= 1
        keep.append(own[last:a])
        last = b
    keep.append(own[last:])
    return np.concatenate(keep).tobytes()
