"""Query of the toxicity classifier: learned from documents whose crc32 modulo 4 is not 2, applied to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import crc_mod, table
from provspark.llm.registry import query
from provspark.llm.toxicity import learn, score

LEAST = 0.3


def may_learn() -> Column:
    return crc_mod(F.col("doc_id"), 4) != 2


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row with a null id is in no fold: it is scored and teaches nothing."""
    model = learn(docs.select("doc_id", "text"), labels, may_learn())
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return rows.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))
