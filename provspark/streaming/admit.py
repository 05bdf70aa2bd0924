"""Continuous admission and run-once part processing on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators.admission import admit_with_quota, only_new
from provspark.operators.sampling import first_occurrence


def _read_log(spark: SparkSession, log: str, schema: str, before: int) -> DataFrame:
    """Decisions of earlier batches; a repeated batch does not see its own first attempt."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(log).where(F.col("batch") < before).drop("batch")


def admit_batch(
    batch: DataFrame, decided: DataFrame, kind: str, policy: Mapping[str, Sequence[str]], n: int, item: str = "item_id"
) -> DataFrame:
    """One batch: skip decided ids and repeated ids, count stored rows per creator so far, decide.

    Of the log only the ids and the stored rows of creators in this batch are used, both as column-pruned scans.
    """
    fresh = only_new(first_occurrence(batch, [item], item), decided, item)
    prior = (
        decided.where(F.col("reason").isNull() & F.col("creator").isNotNull())
        .join(batch.select("creator").distinct(), "creator", "left_semi")
        .groupBy("creator")
        .agg(F.count("*").alias("prior"))
    )
    return admit_with_quota(fresh, kind, policy, n, prior=prior, arrival=item).select(item, "creator", "reason")


def admit_stream(
    candidates: DataFrame, log: str, checkpoint: str, kind: str, policy: Mapping[str, Sequence[str]], n: int
):
    """Start the stream (available-now). Each batch writes its own ``batch=<id>`` folder with overwrite, so a batch
    that is repeated after a failure replaces its first attempt."""
    schema = "item_id BIGINT, creator STRING, reason STRING"

    def step(batch: DataFrame, batch_id: int) -> None:
        decided = _read_log(batch.sparkSession, log, schema, batch_id)
        out = admit_batch(batch, decided, kind, policy, n)
        out.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (
        candidates.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def process_parts_once(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame],
    per_trigger: int = 1,
):
    """Every finished part file is processed exactly once; a restart continues with the next part."""
    parts = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    query = (
        work(parts)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
