"""Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import os
import resource
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.session import bounded_batches, cut_lineage, release, settle  # noqa: F401

U64 = np.uint64
#: Resident bytes from which a worker gives memory back after a task.
GROWN = 200 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, least: int = 12) -> int:
    """Partitions of a shuffle of byte blobs: the session's number, which is sized to the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that a task's memory has a bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def with_nodes(rows: DataFrame, digest: Column) -> tuple[DataFrame, int]:
    """``rows`` (id, not null, ...) with ``node``, a long for each unlike content of an id, and the number of bits that it
    has more than the id: ``node >> bits`` is the id, and nodes rise with ids.

    ``digest`` tells contents apart. As a rule no id has two; then the node is the id, found by counting ids alone. Else
    the unlike contents of such ids are numbered in order of their digests, an id with very many of them by ranges.
    """
    from provspark.llm.merkle import positions

    twice = cut_lineage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():
        return rows.withColumn("node", F.col("id")), 0
    unlike = rows.join(settle(twice), "id", "left_semi").select(F.col("id").alias("grp"), digest.alias("digest")).distinct()
    numbered = cut_lineage(positions(unlike, [F.col("digest")]).where("total > 1"))
    known = numbered.agg(F.max("total").alias("most"), F.max(F.abs("grp")).alias("far")).first()
    if known["most"] is None:
        return rows.withColumn("node", F.col("id")), 0
    bits = (known["most"] - 1).bit_length()
    far = rows.agg(F.max(F.abs("id"))).first()[0]
    if far >= 1 << (62 - bits):
        raise OverflowError(f"{known['most']} unlike contents of one id leave no room for ids up to {far}")
    own = settle(numbered.select(F.col("grp").alias("id"), F.col("digest").alias("_digest"), F.col("pos").alias("_pos")))
    met = rows.withColumn("_digest", digest).join(own, ["id", "_digest"], "left")
    node = F.shiftleft("id", bits) + F.coalesce("_pos", F.lit(0).cast("long"))
    return met.withColumn("node", node).drop("_digest", "_pos"), bits


def text_digest(text: str = "text") -> Column:
    """sha256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of a 64-bit value."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def blobs(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _resident() -> int:
    """Resident bytes of this process; where Linux doesn't tell, the most there were so far."""
    if os.path.exists("/proc/self/statm"):
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10


def tidied(run: Callable) -> Callable:
    """``run`` over batches; a worker that has grown gives its memory back at the end of the task.

    Workers are kept for later tasks, also while other stages need the memory; functions come by value with every task,
    and what they hold goes only when garbage is collected.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if _resident() > GROWN:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
            if trim:
                trim(0)

    return task
