"""Query of suffix-array deduplication over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import table
from provspark.llm.registry import query
from provspark.llm.repeats import repeated_spans, without_spans


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def digests(docs: DataFrame) -> DataFrame:
    rows = without_spans(docs.select("doc_id", "text"), repeated_spans(docs))
    length = F.aggregate(F.zip_with("start", "end", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(length, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_size("start"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
