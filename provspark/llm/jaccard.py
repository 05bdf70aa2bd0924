"""N-gram Jaccard join: T-occurrence search over inverted lists, short ones merged and long ones probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, bounded_batches, mix, parts, pieces, release, text_digest, tidied, utf8, with_nodes
from provspark.llm.components import components
from provspark.llm.packed import SCHEMA, deltas, entries, planes, starts, undeltas, unplanes
from provspark.llm.packed import owner as owner_of
from provspark.llm.packed import rows as packed
from provspark.llm.words import split, unspaced
from provspark.session import cut_lineage

#: Words of a shingle; two documents link when LEAST[1] * common >= LEAST[0] * united.
WORDS, LEAST = 5, (75, 100)
#: Shingles that a task holds before it hands them on in blobs, and low bits of their hashes that are not sent: with 56
#: bits, two unlike sets of a thousand shingles share one by chance once in 10 ** 11 pairs.
HELD, UNSENT = 1_000_000, 8
#: Ranges of shingles for each of the session's shuffle partitions.
RANGES = 2
#: Weight of the logarithm in the choice of how many lists are probed instead of merged.
PROBE = 0.01
#: Rounds in which each list's members meet one of them, before the members that are still apart meet each other.
ROUNDS = 1
#: Documents of a block (about), where those that are still apart are searched block against block.
BLOCK = 256


def needed(n: np.ndarray | int, m: np.ndarray | int = 0):
    """Least overlap of a set of n shingles with any partner, or with one of m shingles."""
    a, b = LEAST
    return -(-a * n // b) if isinstance(m, int) and m == 0 else -(-a * (n + m) // (a + b))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles; one for all words of a text with fewer."""
    words = split(raw, offsets, unspaced())
    h = words.hash
    factors = mix(np.arange(1, WORDS + 1, dtype=U64)) | U64(1)
    rolled = np.zeros(max(0, len(h) - WORDS + 1), U64)
    for j in range(WORDS):
        rolled += h[j : j + len(rolled)] * factors[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = (h[a:b] * factors[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _post(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Blobs of (shingle, document) by ranges of shingles, and of (document, size, two keys of its set) by documents."""
    ids, sets, held = [], [], 0

    def flush() -> pa.RecordBatch:
        size = np.array([len(s) for s in sets])
        doc, h = np.repeat(np.array(ids, np.int64), size), np.concatenate(sets)
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        cuts = np.searchsorted(h, starts(n_parts))
        out = []
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)):
            if b > a:
                out.append((p, 0, deltas(h[a:b] >> U64(UNSENT)), planes(doc[a:b])))
        keys = np.array([_key(s) for s in sets], U64).reshape(-1, 2).view(np.int64)
        owner = owner_of(np.array(ids, np.int64), n_parts)
        for p in np.unique(owner):
            i = np.flatnonzero(owner == p)
            out.append((int(p), 1, planes(np.array(ids, np.int64)[i]), planes(size[i]), planes(keys[i, 0]), planes(keys[i, 1])))
        return packed(out)

    for batch in pieces(batches, "text", 1 << 19):
        found = shingle_sets(*utf8(batch.column("text")))
        ids += batch.column("id").to_pylist()
        sets += found
        held += sum(map(len, found))
        if held >= HELD:
            yield flush()
            ids, sets, held = [], [], 0
    if ids:
        yield flush()


def _key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=U64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))


def _share(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Of a range of shingles, those of two documents or more, with their number of documents, by document."""
    by_part: dict[int, list] = {}
    for part, kind, *blob in entries(batches):
        if kind == 1:
            yield packed([(part, 1, *blob)])
        else:
            by_part.setdefault(part, []).append((undeltas(blob[0]), unplanes(blob[1])))
    for part in list(by_part):
        lists = by_part.pop(part)
        h, doc = (np.concatenate(x) for x in zip(*lists, strict=True))
        del lists
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        count = np.diff(first, append=len(h))
        kept = np.repeat(count > 1, count)
        count = count[count > 1]
        # from here on a shingle is its number in the range: small differences, which compress
        number = np.repeat((part << 36) + np.arange(len(count)), count)
        doc, count = doc[kept], np.repeat(count, count)
        owner = owner_of(doc, n_parts)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            i = order[cuts[p] : cuts[p + 1]]
            yield packed([(int(p), 0, deltas(number[i].view(U64)), planes(doc[i]), planes(count[i]))])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its size and keys, its shared shingles (packed) and the rarest of them, which are its short
    lists; null where they are too few for any partner: no document can link with it."""
    meta, shared = [], []
    for _, kind, a, b, c, d in entries(batches):
        if kind == 1:
            meta.append([unplanes(x) for x in (a, b, c, d)])
        else:
            shared.append((undeltas(a).view(np.int64), unplanes(b), unplanes(c)))
    if not meta:
        return
    ids, size, k1, k2 = (np.concatenate(x) for x in zip(*meta, strict=True))
    out: list[bytes | None] = [None] * len(ids)
    rare: list[np.ndarray | None] = [None] * len(ids)
    if shared:
        h, doc, count = (np.concatenate(x) for x in zip(*shared, strict=True))
        # most documents have too few shared shingles: they are left out before the sort
        known, place, total = np.unique(doc, return_inverse=True, return_counts=True)
        least = np.zeros(len(known), np.int64)
        at = np.searchsorted(known, ids)
        hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids)
        least[at[hit]] = needed(size[hit])
        enough = (total >= least)[place]
        h, doc, count = h[enough], doc[enough], count[enough]
        order = np.lexsort((h, count, doc))
        h, doc = h[order], doc[order]
        start, end = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        for i in np.flatnonzero(end > start):
            own = _once(h[start[i] : end[i]])  # a repeated row has its postings twice
            if len(own) >= needed(int(size[i])):
                out[i] = pack(own)
                rare[i] = own[: len(own) - needed(int(size[i])) + 1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(size), pa.array(k1), pa.array(k2), pa.array(out, pa.binary()), pa.array(rare, pa.list_(pa.int64()))],
        ["id", "n", "k1", "k2", "shared", "rare"],
    )


def pack(own: np.ndarray) -> bytes:
    return pa.compress(deltas(np.sort(own).view(U64)), codec="lz4", asbytes=True) + len(own).to_bytes(4, "little")


def unpack(raw: bytes) -> np.ndarray:
    """The shingles of ``pack`` in rising order."""
    n = int.from_bytes(raw[-4:], "little")
    return undeltas(pa.decompress(raw[:-4], decompressed_size=8 * n, codec="lz4", asbytes=True)).view(np.int64)


def _once(h: np.ndarray) -> np.ndarray:
    first = np.sort(np.unique(h, return_index=True)[1])
    return h if len(first) == len(h) else h[first]


class Lists:
    """Inverted lists of a block of sets: the members of each shingle, in rising order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        h, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(h, kind="stable")
        h, self.member = h[order], member[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        self.shingle, self.start = h[first], np.append(first, len(h))
        self.sizes = sizes

    def search(self, query: np.ndarray, n: int) -> np.ndarray:
        """Overlap of each set that reaches the needed one with the query (sorted, of n shingles), else 0.

        The longest lists of the query, of a number that grows with the needed overlap T, are set aside: the others are
        merged, and only sets that occur T - (lists set aside) times are looked up in the long ones by binary search.
        """
        need = needed(n, self.sizes)
        total = np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(self.shingle, query)
        at = at[at < len(self.shingle)]
        at = np.unique(at[np.isin(self.shingle[at], query)])
        if not len(at):
            return total
        start, end = self.start[at], self.start[at + 1]
        length = end - start
        least = int(need.min())
        aside = max(0, min(int(least / (PROBE * np.log2(max(2, int(length.max()))) + 1)), least - 1, len(at) - 1))
        order = np.argsort(length, kind="stable")
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        merged = np.sort(np.concatenate([self.member[start[k] : end[k]] for k in short]), kind="stable")  # runs merge
        count = np.bincount(merged, minlength=len(total))
        able = np.flatnonzero(count >= np.maximum(need - aside, 1))
        seen = count[able]
        for left, k in enumerate(long[::-1], 1 - len(long)):
            if not len(able):
                break
            row = self.member[start[k] : end[k]]
            seen = seen + (row[np.minimum(np.searchsorted(row, able), len(row) - 1)] == able)
            on = seen - left >= need[able]  # what is left could still fill the gap
            able, seen = able[on], seen[on]
        total[able] = seen
        return np.where(total >= need, total, 0)


def occurrences(query: np.ndarray, n: int, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    return Lists(sets, sizes).search(np.sort(query), n)


def _apart(t: pa.Table) -> pa.Table:
    """Links between two blocks of a cell, or within one, as far as they join components."""
    t = t.combine_chunks()
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    chunk, ids, n = (t.column(c).to_numpy() for c in ("chunk", "id", "n"))
    group = {x: x for x in t.column("component").to_pylist()}
    component = t.column("component").to_pylist()
    sets = [unpack(x) for x in t.column("shared").to_pylist()]

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    ours, theirs = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    out = []
    if len(ours) and len(theirs):
        lists = Lists([sets[j] for j in theirs], n[theirs])
        for i in ours:
            overlap = lists.search(sets[i], int(n[i]))
            for j in np.flatnonzero(overlap):
                x, y = root(component[i]), root(component[theirs[j]])
                if x != y:
                    group[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(ids[theirs[j]]), int(overlap[j])))
    found = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "overlap"), found, strict=True)})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one query that follow each other are searched together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q, c = batch.column("q").to_numpy(), batch.column("c").to_numpy()
        q_n, c_n = batch.column("q_n").to_numpy(), batch.column("c_n").to_numpy()
        q_set, c_set = batch.column("q_set"), batch.column("c_set")
        cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        good = np.zeros(len(q), np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            sets = [unpack(x) for x in c_set.slice(a, b - a).to_pylist()]
            good[a:b] = occurrences(unpack(q_set[a].as_py()), int(q_n[a]), sets, c_n[a:b])
        i = good > 0
        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[i]), pa.array(good[i])], ["a", "b", "overlap"])


def _shared_sets(rows: DataFrame, n_parts: int) -> DataFrame:
    posted = rows.mapInArrow(tidied(lambda b: _post(b, n_parts)), SCHEMA)
    shared = posted.repartitionById(n_parts, "part").mapInArrow(tidied(lambda b: _share(b, n_parts)), SCHEMA)
    schema = "id long, n long, k1 long, k2 long, shared binary, rare array<bigint>"
    return cut_lineage(shared.repartitionById(n_parts, "part").mapInArrow(tidied(_gather), schema))


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    c = sets.select(F.col("id").alias("c"), F.col("n").alias("c_n"), F.col("shared").alias("c_set"))
    q = sets.select(F.col("id").alias("q"), F.col("n").alias("q_n"), F.col("shared").alias("q_set"))
    met = pairs.join(c, "c").join(q, "q").select("q", "q_n", "q_set", "c", "c_n", "c_set")
    return cut_lineage(met.mapInArrow(tidied(_verify), "a long, b long, overlap long"))


def _in_several(lists: DataFrame) -> DataFrame:
    """Lists whose members lie in several components."""
    spans = lists.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return cut_lineage(lists.join(spans.where("low <> high").select("h"), "h"))


def _between_blocks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between documents of one cell (joined by the lists that they share) that are still apart.

    A cell is dealt to blocks of about ``BLOCK`` documents, and a task searches one block against another, so no cell is
    gathered; no pair leaves a task unless it joins two components.
    """
    least = lists.groupBy("h").agg(F.min("id").alias("b"))
    cells = components(lists.join(least, "h").select(F.col("id").alias("a"), "b")).withColumnsRenamed(
        {"node": "id", "component": "cell"}
    )
    cells = cut_lineage(cells)
    blocks = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = lists.select("id", "component").distinct().join(cells, "id").join(blocks, "cell")
    member = member.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = member.join(sets.select("id", "n", "shared"), "id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("chunk", "k"), "b": F.greatest("chunk", "k")})
    tiles = rows.groupBy("cell", "a", "b").applyInArrow(_apart, "a long, b long, overlap long")
    return cut_lineage(tiles)


def _united(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with further links: only the components that these join are searched again."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = cut_lineage(components(between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("least"))
    nodes = groups.select("node", "component").unionByName(over.select(F.col("component").alias("node"), "component"))
    return nodes.distinct().join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component")).distinct()


def _by_id(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes as ids; the components of an id's texts are one."""
    rows = cut_lineage(nodes.withColumns({c: F.shiftright(c, bits) for c in ("id", "rep")}))
    least = rows.groupBy("id").agg(F.min("component").alias("b"), F.max("component").alias("_high")).where("b <> _high")
    groups = components(rows.join(least, "id").select(F.col("component").alias("a"), "b"))
    joined = groups.select(F.col("node").alias("component"), F.col("component").alias("_joined"))
    met = rows.join(joined, "component", "left")
    component = F.shiftright(F.coalesce("_joined", "component"), bits)
    return met.select("id", "n", "rep", component.alias("component"))


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, n, rep, component; links: a, b, overlap between representatives of sets).

    Words are what white space (0x09-0x0D, 0x20) parts, A-Z lower-cased; a document's set are its shingles of five words,
    or all its words as one if it has fewer. Documents without words, and null texts, have empty sets and link with
    nothing. Documents of one set are one representative (the smallest id) and linked. Links hold enough pairs to
    join each component, every one of them verified. Rows that repeat an id and text are one node; texts that share an id
    are searched each, and are in one component. Rows without an id are returned with their size and no component.

    Shingles go to ranges of their hashes in blobs; there those of a single document end, which leaves few documents
    with enough shared ones. The rarest shared shingles of a set, as many as the overlap that it needs allows to miss,
    are its short lists: whoever links shares one. In each list one member is searched against the others; members of lists that then
    lie in several components are searched block against block.
    """
    n_parts = RANGES * parts(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    nodes, bits = with_nodes(rows.where("id is not null"), text_digest())
    sets = _shared_sets(nodes.select(F.col("node").alias("id"), "text"), n_parts)
    release(docs.sparkSession)
    able = sets.where("shared is not null")
    reps = able.groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), F.first("shared").alias("shared"), F.first("rare").alias("rare"))
    reps = cut_lineage(reps)
    lists = reps.select(F.explode("rare").alias("h"), "id", "n", F.col("id").alias("component"))
    found = None
    for k in range(ROUNDS):
        lists = _in_several(lists)
        if lists.isEmpty():
            break
        met = F.struct(F.xxhash64("id", F.lit(k)).alias("o"), "id", "n", "component")
        leads = lists.groupBy("h").agg(F.min(met).alias("l"))
        fits = (F.col("component") != F.col("l.component")) & _fits(F.col("n"), F.col("l.n"))
        pairs = lists.join(leads, "h").where(fits).select(F.col("l.id").alias("q"), F.col("id").alias("c")).distinct()
        new = _links(pairs, reps)
        found = new if found is None else found.unionByName(new)
        release(docs.sparkSession)  # of the sets on their way to the search
        groups = cut_lineage(components(found.select("a", "b")))
        lists = lists.select("h", "id", "n").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        lists = lists.select("h", "id", "n", F.coalesce("component", "id").alias("component"))
    lists = _in_several(lists)
    if not lists.isEmpty():
        joined = _between_blocks(lists, reps)
        found = found.unionByName(joined)
        groups = cut_lineage(_united(groups, joined.select("a", "b")))
    member = able.select("id", "n", "k1", "k2").join(
        reps.select("n", "k1", "k2", F.col("id").alias("rep")), ["n", "k1", "k2"]
    ).select("id", "n", "rep")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "a long, b long, overlap long")
        placed = member.withColumn("component", F.col("rep"))
    else:
        named = groups.select(F.col("node").alias("rep"), "component")
        placed = member.join(named, "rep", "left").select("id", "n", "rep", F.coalesce("component", "rep").alias("component"))
    alone = sets.where("shared is null").select("id", "n", F.col("id").alias("rep"), F.col("id").alias("component"))
    known = placed.unionByName(alone)
    if bits:
        known, found = _by_id(known, bits), found.withColumns({c: F.shiftright(c, bits) for c in ("a", "b")})
    nameless = rows.where("id is null").mapInArrow(tidied(_sizes), "n long")
    none = F.lit(None).cast("long")
    return known.unionByName(nameless.select(none.alias("id"), "n", none.alias("rep"), none.alias("component"))), found


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 19):
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(*utf8(batch.column("text")))], pa.int64())], ["n"])
