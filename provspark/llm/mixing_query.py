"""Query of the mixing operator: good and poor prose by the labelled table, mixed three to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import table
from provspark.llm.mixing import mix
from provspark.llm.registry import query

#: Share of the tokens that documents of each domain should have.
WEIGHTS = {"good": 0.75, "poor": 0.25}


def domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), WEIGHTS)
