"""URL filters as a sort-merge range join with a stack of nested rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import parts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys looked at per bucket when the bounds of the buckets are chosen; their number only evens out the load.
PER_BUCKET, BOUND_BYTES = 64, 96


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse order, a dot behind each: a host and its subdomains are the keys with one prefix."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "UTF-8")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``rules`` has host, path and verdict (allow or block).

    A rule fits a url of its host or a subdomain whose path starts with the rule's. The longest rule (host and path
    together) wins, of equally long ones the one with the longer host, then block. Without a rule the rule is null and
    the verdict ``default``. Null urls and urls without ``://`` have empty host and path; rows, repeated or with null
    ids, are each judged alone. Columns of ``urls`` besides the two are not read.

    Method: a rule is the interval of reversed-host keys with its prefix. Keys are cut into ranges of about equal size
    (equal keys may be dealt to several); a rule goes to every range that it overlaps, which for nested intervals is
    one range or an unbroken run. Each range is sorted, rules before urls, and swept with a stack of open rules.
    """
    spark = urls.sparkSession
    rows = urls.select(
        F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("key", host_key(F.col("host")))
    n = parts(spark)
    bounds = _bounds(rows, n)
    held = spark.sparkContext.broadcast(bounds)  # below n keys of BOUND_BYTES
    marks = rules.select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict",
    ).withColumn("key", host_key(F.col("host")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = held.value
        for batch in batches:
            bucket = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                low, high = bisect_left(cuts, key[:BOUND_BYTES]), bisect_right(cuts, key[:BOUND_BYTES])
                bucket.append(low + i % (high - low + 1))
            yield batch.append_column("bucket", pa.array(bucket, pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = held.value
        for batch in batches:
            row, bucket = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                first, last = bisect_left(cuts, key[:BOUND_BYTES]), bisect_right(cuts, key[:-1] + b"/")
                row += [i] * (last - first + 1)
                bucket += range(first, last + 1)
            yield batch.take(pa.array(row, pa.int64())).append_column("bucket", pa.array(bucket, pa.int32()))

    def schema(df: DataFrame):
        return df.withColumn("bucket", F.lit(0)).schema

    dealt = rows.withColumn("verdict", F.lit(None).cast("string")).select("id", "host", "path", "verdict", "key")
    marks = marks.select("id", "host", "path", "verdict", "key")
    both = (
        dealt.mapInArrow(deal, schema(dealt)).withColumn("is_url", F.lit(True))
        .unionByName(marks.mapInArrow(spread, schema(marks)).withColumn("is_url", F.lit(False)))
        .repartitionById(n, "bucket")
        .sortWithinPartitions("bucket", "key", "is_url")
    )
    out = rows.select("id", "host", "path").withColumns(
        {"rule": F.lit(None).cast("string"), "verdict": F.lit("").cast("string")}
    )
    return both.mapInArrow(lambda batches: _sweep(batches, default), out.schema).withColumnRenamed("id", id_col)


def _bounds(rows: DataFrame, n: int) -> list[bytes]:
    """n - 1 keys that cut the rows into about equal ranges, from about ``PER_BUCKET * n`` rows spread over all."""
    total = rows.count()
    if not total:
        return []
    some = rows.sample(min(1.0, PER_BUCKET * n / total), seed=1).select(F.substring("key", 1, BOUND_BYTES).alias("key"))
    keys = sorted(bytes(r.key) for r in some.collect())
    return [keys[i * len(keys) // n] for i in range(1, n)] if keys else []


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[bytes, list[tuple[str, str, str]]]] = []  # prefix, its (path, rule, verdict), longest path first
    now = None
    for batch in batches:
        kept, rules, verdicts = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "key", "is_url", "host", "path", "verdict"))
        for i, (bucket, key, is_url, host, path, verdict) in enumerate(zip(*columns, strict=True)):
            if bucket != now:
                stack, now = [], bucket
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                own = stack[-1][1]
                own.append((path or "", f"{host}{path or ''}", verdict))
                own.sort(key=lambda r: (-len(r[0]), r[2] != "block"))
                continue
            best = None
            for prefix, own in stack:  # from the shortest host to the longest
                hit = next((r for r in own if path.startswith(r[0])), None)
                if hit and (best is None or len(hit[1]) >= len(best[1])):
                    best = hit
            kept.append(i)
            rules.append(best and best[1])
            verdicts.append(best[2] if best else default)
        some = batch.select(["id", "host", "path"]).take(pa.array(kept, pa.int64()))
        yield some.append_column("rule", pa.array(rules, pa.string())).append_column("verdict", pa.array(verdicts, pa.string()))
