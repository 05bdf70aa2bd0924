"""Manifests: one row per decided item, kept or rejected; keys differ by source."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The union of the keys that manifests carry.
MANIFEST_SCHEMA = (
    "id STRING, user STRING, artist STRING, basis STRING, model STRING, rating STRING, nsfw STRING, created STRING, "
    "w INT, h INT, real DOUBLE, tags ARRAY<STRING>, prompt STRING, text STRING, job STRING, sha256 STRING, "
    "datei STRING, gw INT, gh INT, grund STRING, split STRING, version STRING, fenster STRING, _corrupt_record STRING"
)


KEYS = [part.split()[0] for part in MANIFEST_SCHEMA.split(", ")][:-1]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("_t", F.from_json("value", MANIFEST_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))


def read_manifest(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """JSON lines with one fixed schema; missing keys become null, and a JSON object ``rest`` holds all other keys.

    A line that is no JSON object fails the read, unless it is to be skipped: ``unreadable_lines`` returns such lines.
    """
    rows = _lines(spark, path)
    bad = F.col("_t._corrupt_record").isNotNull()
    if skip_unreadable:
        rows = rows.where(~bad)
    else:
        message = F.concat(F.lit("unreadable manifest line: "), F.col("value"))
        rows = rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    other = F.map_filter(F.from_json("value", "map<string, variant>"), lambda k, v: ~k.isin(*KEYS))
    partitions = [c for c in rows.columns if c not in ("value", "_t")]
    return rows.select(*(F.col(f"_t.{k}") for k in KEYS), *partitions, F.nullif(F.to_json(other), F.lit("{}")).alias("rest"))


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_manifest`` refuses."""
    return _lines(spark, path).where(F.col("_t._corrupt_record").isNotNull()).select("value")


def kept_rows(manifest: DataFrame) -> DataFrame:
    """Rows with a file and without a reject reason; an empty name is no file."""
    return manifest.where((F.coalesce(F.col("datei"), F.lit("")) != "") & (F.coalesce(F.col("grund"), F.lit("")) == ""))


def _json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; the keys in ``rest`` stand beside the columns again."""
    own = F.to_json(F.struct(*[c for c in df.columns if c != "rest"]))
    if "rest" not in df.columns:
        return df.select(own.alias("value"))
    rows = df.select(own.alias("own"), "rest").select("own", "rest", F.when(F.col("own") == "{}", "").otherwise(",").alias("c"))
    joined = F.concat(F.expr("left(own, length(own) - 1)"), F.col("c"), F.expr("substring(rest, 2)"))
    return rows.select(F.when(F.col("rest").isNull(), F.col("own")).otherwise(joined).alias("value"))


def append_manifest(df: DataFrame, path: str, partition: str = "source") -> None:
    df.write.mode("append").partitionBy(partition).json(path)


def rewrite_manifest(df: DataFrame, root: str) -> str:
    """Write a complete new version beside the old ones and point to it last; readers see the old or the new table.

    Keys that the schema does not name are written back from ``rest``.
    """
    version = f"v-{uuid.uuid4().hex}"
    _json_lines(df).write.mode("errorifexists").text(f"{root}/{version}")
    spark = df.sparkSession
    stamp = F.unix_micros(F.current_timestamp())
    pointer = spark.range(1).select(F.lit(version).alias("version"), stamp.alias("written"))
    pointer.coalesce(1).write.mode("append").json(f"{root}/_current.d")
    return version


def current_manifest(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.schema("version STRING, written BIGINT").json(f"{root}/_current.d")
    version = newest.agg(F.max_by("version", "written")).first()[0]
    return read_manifest(spark, f"{root}/{version}")


def scan_files(
    spark: SparkSession, root: str, extensions: Sequence[str], exclude: Sequence[str] = ("_ai_quarantine",),
    modified_before: str | None = None,
) -> DataFrame:
    """Recursive inventory (path, modificationTime, length); the content column is never read."""
    glob = "*.{" + ",".join(sorted({e for x in extensions for e in (x.lower(), x.upper())})) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_before:
        reader = reader.option("modifiedBefore", modified_before)
    files = reader.load(root).select("path", "modificationTime", "length")
    keep = ~F.contains("path", F.lit("_thumb."))
    for part in exclude:
        keep = keep & ~F.contains("path", F.lit(part))
    return files.where(keep)


def drop_unreadable(df: DataFrame, content: str = "content", least: int = 1) -> DataFrame:
    """Rows whose payload is missing or shorter than ``least`` bytes leave every group."""
    return df.where(F.col(content).isNotNull() & (F.octet_length(content) >= least))
