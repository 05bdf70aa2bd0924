"""Columnar, CSV, relational and list sources, and the sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.operators.scan import row_index


def read_parquet_cols(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and quoted line breaks; a byte-order mark before the first header is removed."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_relational(
    spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """JDBC table; filters and columns are pushed to the source. ``partition`` = (column, lower, upper, parts)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if partition:
        column, lower, upper, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower)
        reader = reader.option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case paths, blanks dropped."""
    from provspark.operators.admission import normalise_paths

    return normalise_paths(spark.read.text(path), "value")


def write_scores_csv(df: DataFrame, path: str, item: str, score: str = "score") -> None:
    """Ranked report: best first, equal scores by item, unscored last with an empty probability, four decimals,
    semicolons; ``place`` counts from 1. Files are ranges of the ranking in order."""
    from provspark.functions.numeric import sigmoid

    order = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    placed = row_index(df.withColumn("_order", order), "_order", "place", ties=[item]).withColumn("place", F.col("place") + 1)
    ranked = placed.drop("_order").orderBy("place")
    shown = F.when(F.col(score).isNotNull(), F.format_string("%.4f", sigmoid(F.col(score))))
    ranked.withColumn("probability", shown).write.mode("overwrite").csv(
        path, sep=";", header=True
    )


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Long metric table (detector, group, kind, metric, value, n)."""
    df.write.mode("overwrite").format(fmt).save(path)


def save_heads(heads: DataFrame, path: str) -> None:
    heads.write.mode("append").partitionBy("tag").parquet(path)


def load_ensemble(heads: DataFrame, tag: str) -> DataFrame:
    """Heads of a tag with seeds 0, 1, 2, ... up to the first gap. An ensemble is a handful of rows."""
    chosen = heads.where(F.col("tag") == tag)
    place = F.row_number().over(Window.partitionBy("tag").orderBy("seed")) - 1
    return chosen.withColumn("_place", place).where(F.col("seed") == F.col("_place")).drop("_place")


def export_heads(heads: DataFrame, tag: str) -> DataFrame:
    """Weights as FLOAT with a SHA-256 per head, and the metadata of the ensemble."""
    arrays = [f.name for f in heads.schema.fields if f.dataType.simpleString() == "array<double>"]
    chosen = load_ensemble(heads, tag)
    small = chosen.withColumns({c: F.col(c).cast("array<float>") for c in arrays})
    weights = F.to_json(F.struct(*[c for c in small.columns if c not in ("tag", "seed")]))
    return small.withColumn("sha256", F.sha2(weights, 256)).withColumn("input_dim", F.size("mean"))


def merge_ensembles(heads: DataFrame, tags: Sequence[str], new_tag: str) -> DataFrame:
    """Several ensembles as one: seeds are renumbered in the order of the tags."""
    order = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    seed = F.row_number().over(Window.partitionBy(F.lit(new_tag)).orderBy(order, "seed")) - 1
    return heads.where(F.col("tag").isin(*tags)).withColumn("seed", seed).withColumn("tag", F.lit(new_tag))
