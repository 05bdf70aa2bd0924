"""Query of language identification: trained on documents whose crc32 modulo 3 is not 1, applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import crc_mod, table
from provspark.llm.langid import predict, train
from provspark.llm.registry import query


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def identified(docs: DataFrame) -> DataFrame:
    """A row with a null id is in no fold: it is predicted and teaches nothing."""
    fold = crc_mod(F.col("doc_id"), 3)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    model = train(docs.where(fold != 1), draw)
    held_out = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return predict(held_out, model).drop("text")
