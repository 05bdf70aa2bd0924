"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the words of every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, blobs, bounded_batches, lists, mix, pieces, tidied, utf8
from provspark.llm.words import alphanumeric, split
from provspark.session import cut_lineage

#: Words of a window, first words of a segment of an item, bytes of the items of one broadcast (about).
WINDOW, SEGMENT, BLOCK_BYTES = 10, 4096, 8 << 20
#: Multiplier that joins the hashes of consecutive words; hits that are verified at once.
JOIN, VERIFIED = U64(0xC2B2AE3D27D4EB4F), 1 << 14
FOUND = "n_words long, runs array<struct<first:long,last:long,start:long,end:long>>, items array<long>"


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each item, one space between them, in segments that overlap by all words of a window but one."""
    for batch in pieces(batches, "text", 1 << 20):
        raw, offsets = utf8(batch.column("text"))
        normal = alphanumeric()
        words, form = split(raw, offsets, normal), normal[raw]
        ids, out = [], []
        for i, item in enumerate(batch.column("item").to_pylist()):
            first, end = int(words.first[i]), int(words.first[i + 1])
            for at in range(first, max(first + 1, end - window + 1), SEGMENT):
                own = slice(at, min(end, at + SEGMENT + window - 1))
                if at < end:
                    ids.append(item)
                    out.append(b" ".join(form[a:b].tobytes() for a, b in zip(words.start[own], words.end[own], strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), blobs(out)], ["item", "segment"])


def window_hashes(words: np.ndarray, first: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, first words, hashes) of all windows of m words, for each of the rising ``lengths``; none leaves its text."""
    last = np.repeat(first[1:], np.diff(first))  # behind the last word of the text of each word
    at, value = np.arange(len(words)), np.zeros(len(words), U64)
    for m in range(1, (lengths or [0])[-1] + 1):
        fits = at + m <= last[at]
        at, value = at[fits], value[fits]
        value = value * JOIN + words[at + m - 1]
        if m in lengths:
            yield m, at, mix(value ^ U64(m))


def same_words(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the windows of m words from word i of ``a`` and from word j of ``b`` have the same bytes, for each triple.

    ``a`` and ``b`` are (bytes, starts, ends) of words.
    """
    out = np.ones(len(i), bool)
    for s in range(0, len(i), VERIFIED):
        t = slice(s, s + VERIFIED)
        pair = np.repeat(np.arange(len(m[t])), m[t])
        step = np.arange(len(pair)) - np.repeat(np.cumsum(m[t]) - m[t], m[t])
        u, v = i[t][pair] + step, j[t][pair] + step
        size = a[2][u] - a[1][u]
        bad = size != b[2][v] - b[1][v]
        out[s + pair[bad]] = False
        u, v, pair, size = u[~bad], v[~bad], pair[~bad], size[~bad]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        unlike = a[0][np.repeat(a[1][u], size) + inside] != b[0][np.repeat(b[1][v], size) + inside]
        out[s + np.repeat(pair, size)[unlike]] = False
    return out


def build_index(items: list[int | None], segments: list[bytes], window: int = WINDOW) -> dict:
    """The hash set of the windows of some segments, as plain arrays.

    ``hash`` has the hash of each unlike window, sorted, ``word`` and ``length`` where its words stand in ``text``,
    ``item`` the items of window g from ``first[g]`` to ``first[g + 1]``. ``flags`` tells by its low bits that a hash is
    in no window.
    """
    raw = np.frombuffer(b"".join(segments), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    words = split(raw, offsets, alphanumeric())
    size = np.diff(words.first)
    owner = np.repeat(np.arange(len(segments)), size)
    lengths = sorted({int(min(n, window)) for n in size if n})
    found = []
    for m, at, value in window_hashes(words.hash, words.first, lengths):
        whole = np.minimum(size[owner[at]], window) == m  # shorter windows only of segments that have no more words
        found.append((value[whole], at[whole], np.full(int(whole.sum()), m)))
    value, word, length = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (U64, int, int))
    side, kind = (raw, words.start, words.end), np.zeros(len(value), np.int64)
    while True:  # windows that share a hash but not their words are told apart by ``kind``
        order = np.lexsort((kind, value))
        begins = np.ones(len(order), bool)
        begins[1:] = (np.diff(value[order]) != 0) | (np.diff(kind[order]) != 0)
        leader = np.empty(len(order), np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        alike = length == length[leader]
        alike[alike] = same_words(side, side, word[alike], word[leader[alike]], length[alike])
        if alike.all():
            break
        kind[~alike] += 1
    number = np.array([-1 if x is None else x for x in items], np.int64)
    known = np.array([x is not None for x in items], bool)
    group = np.cumsum(begins) - 1
    held = known[owner[word[order]]] if len(order) else np.zeros(0, bool)
    pair = np.unique(np.stack([group[held], number[owner[word[order][held]]]]), axis=1) if held.any() else np.zeros((2, 0), np.int64)
    heads = order[begins]
    bits = max(10, min(24, int(16 * len(heads)).bit_length()))
    flags = np.zeros(1 << bits, bool)
    flags[(value[heads] & U64((1 << bits) - 1)).astype(np.int64)] = True
    return {
        "text": raw.tobytes(), "start": words.start, "end": words.end, "lengths": lengths, "hash": value[heads],
        "word": word[heads], "length": length[heads], "flags": flags, "item": pair[1],
        "first": np.searchsorted(pair[0], np.arange(len(heads) + 1)),
        "most": int(np.bincount(kind).astype(bool).sum()) if len(kind) else 0,
    }


def hits_of(raw: np.ndarray, offsets: np.ndarray, index: dict):
    """(words, hit words, documents and items of the hits): verified occurrences of the windows of ``index``."""
    normal = alphanumeric()
    words = split(raw, offsets, normal)
    mark = np.zeros(len(words.hash) + 1, np.int32)
    side, other = (normal[raw], words.start, words.end), (np.frombuffer(index["text"], np.uint8), index["start"], index["end"])
    low, n, seen = U64(len(index["flags"]) - 1), len(index["hash"]), []
    for m, at, value in window_hashes(words.hash, words.first, index["lengths"]):
        some = index["flags"][(value & low).astype(np.int64)]
        at, value = at[some], value[some]
        place = np.searchsorted(index["hash"], value)
        for more in range(index["most"]):
            g = np.minimum(place + more, max(n - 1, 0))
            fits = np.flatnonzero((place + more < n) & (index["hash"][g] == value) & (index["length"][g] == m))
            i, g = at[fits], g[fits]
            good = same_words(side, other, i, index["word"][g], np.full(len(i), m))
            i, g = i[good], g[good]
            np.add.at(mark, i, 1)
            np.add.at(mark, i + m, -1)
            seen.append((i, g))
    hit = np.cumsum(mark[:-1]) > 0
    i, g = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(words.first[1:], i, side="right")
    pair = np.unique(doc * max(n, 1) + g)
    doc, g = pair // max(n, 1), pair % max(n, 1)
    count = index["first"][g + 1] - index["first"][g] if len(g) else np.zeros(0, np.int64)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = index["item"][np.repeat(index["first"][g], count) + inside] if len(g) else np.zeros(0, np.int64)
    both = np.unique(np.stack([np.repeat(doc, count), item]), axis=1)
    return words, hit, both[0], both[1]


def _found(raw: np.ndarray, offsets: np.ndarray, index: dict) -> list[pa.Array]:
    """The columns of ``FOUND``: maximal runs of hit words, counted within each document, with the bytes they cover."""
    words, hit, doc, item = hits_of(raw, offsets, index)
    size = np.diff(words.first)
    opens, ends = hit.copy(), hit.copy()
    inner = words.first[(words.first > 0) & (words.first < len(hit))]  # runs end with their document
    before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
    before[inner], after[inner - 1] = False, False
    opens, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    owner = np.searchsorted(words.first[1:], opens, side="right")
    runs = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (
            opens - words.first[owner], ends + 1 - words.first[owner],
            words.start[opens] - offsets[owner], words.end[ends] - offsets[owner],
        )], ["first", "last", "start", "end"],
    )
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).astype(np.int32)
    return [
        pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), runs),
        lists(item, np.bincount(doc, minlength=len(size)), pa.int64()),
    ]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and items of all blocks of windows as one list each."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs = sorted((x["first"], x["last"], x["start"], x["end"]) for x in [*r["runs"], *r.pop("more_runs")])
            whole: list[list[int]] = []
            for run in runs:
                if whole and run[0] <= whole[-1][1]:
                    whole[-1][1], whole[-1][3] = max(whole[-1][1], run[1]), max(whole[-1][3], run[3])
                else:
                    whole.append(list(run))
            r["runs"] = [dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in whole]
            r["items"] = sorted({*r["items"], *r.pop("more_items")})
            out.append(r)
        kept = [f for f in batch.schema if not f.name.startswith("more_")]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kept))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``runs`` (maximal runs of hit words: words first to last and bytes start to
    end, ends not included) and ``items`` (ids of the items with an occurring window, sorted, each once).

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is ``window`` consecutive
    words of an item, or all of an item that has fewer; a word is hit if it lies in an occurrence of a window, which no
    document's end may part. Items without words have no windows; those without an id hit words but are not listed.
    Null and empty texts have no words; very long texts are read whole; repeated rows get the same result each; columns of
    ``docs`` with the names of the new ones are replaced.

    The items are settled and measured first. Their windows are broadcast in blocks made of about ``block_bytes`` of item
    text, one after the other, however many it takes; as a rule there is one, and the documents are read once and not
    shuffled. With more blocks each is a pass over the documents, and only its hits are shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    segments = cut_lineage(known.mapInArrow(lambda b: _segments(b, window), "item long, segment binary"))
    total = segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("item", "segment"), F.lit(n_blocks))
    new = ("n_words", "runs", "items")
    rest = [c for c in docs.columns if c not in new]
    rows = docs.select(*(F.col(f"`{c}`") for c in rest))

    def scan(rows: DataFrame, columns: list[str], index: dict, only_hits: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(index)  # of about block_bytes of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text, 1 << 20):
                found = _found(*utf8(batch.column(text)), held.value)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, *new])
                yield out.filter(pa.compute.greater(pa.compute.list_value_length(found[1]), 0)) if only_hits else out

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*(F.col(f"`{c}`") for c in columns)).schema)
        return rows.mapInArrow(tidied(run), kinds + FOUND)

    def index_of(b: int) -> dict:
        part = segments.where(block == b).orderBy("item", "segment").collect()  # about block_bytes
        return build_index([r["item"] for r in part], [bytes(r["segment"]) for r in part], window)

    if n_blocks == 1:
        return scan(rows, rest, index_of(0), False)
    # rows of one text share their hits, so a text is known by its digest
    keyed = rows.withColumn("_text_key", F.sha2(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), 256))
    first = scan(keyed, [*rest, "_text_key"], index_of(0), False)
    more = None
    slim = keyed.select(F.col(f"`{text}`"), "_text_key").dropDuplicates(["_text_key"])
    for b in range(1, n_blocks):
        found = cut_lineage(scan(slim, ["_text_key"], index_of(b), True))
        more = found if more is None else more.unionByName(found)
    more = more.groupBy("_text_key").agg(
        F.flatten(F.collect_list("runs")).alias("more_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items")
    )
    joined = first.join(more, "_text_key", "left").drop("_text_key")
    joined = joined.withColumns({c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("more_runs", "more_items")})
    return joined.mapInArrow(_merged, joined.drop("more_runs", "more_items").schema)


def _cut(batches: Iterator[pa.RecordBatch], text: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, text, 4 << 20):
        out = []
        for raw, runs in zip(batch.column(text).cast(pa.binary()), batch.column("runs").to_pylist(), strict=True):
            raw = raw.as_py()
            if runs:
                ends = [0, *(r["end"] for r in runs)]
                raw = b"".join(raw[a:b] for a, b in zip(ends, [*(r["start"] for r in runs), len(raw)], strict=True))
            out.append(raw)
        kept = pa.array(out, pa.binary()).cast(batch.schema.field(text).type)
        yield pa.RecordBatch.from_arrays([kept if c == text else batch.column(c) for c in columns], columns)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **how) -> DataFrame:
    """``docs`` without the runs of words that occur in the benchmark (``remove="spans"``: the bytes between the first and
    the last hit word of a run go, too), or without the documents that hold any (``remove="documents"``).

    Clean rows stay as they are. Other arguments are those of ``contaminated``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown way to remove: {remove!r}")
    found = contaminated(docs, benchmark, text, **how)
    own = [c for c in docs.columns if c in found.columns and c not in ("n_words", "runs", "items")]
    if remove == "documents":
        return found.where(F.size("runs") == 0).select(*(F.col(f"`{c}`") for c in own))
    chosen = found.select(*(F.col(f"`{c}`") for c in own), "runs")
    return chosen.mapInArrow(lambda b: _cut(b, text, own), chosen.drop("runs").schema)
