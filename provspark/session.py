"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "provspark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings are used as they are."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PROVSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/provspark-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for iterative operators."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """The rows of a round that the next one reads, in files of the shared folder.

    A checkpoint keeps what the planner thought of its columns and of its size. Joins multiply sizes, so in rounds that guess
    takes twice the digits each time, until it fills the driver's memory. Files tell how large they are.
    """
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Fix an intermediate table that is joined to a large one: it is checkpointed, so every branch and retry sees the
    same rows, and computed once, whatever its size.

    Its rows are counted from the checkpoint. Up to ``limit`` of them may be broadcast, so that the large side is not
    shuffled; beyond, the join is left to the planner and the adaptive skew join.
    """
    fixed = cut_lineage(df)
    return F.broadcast(fixed) if fixed.count() <= limit else fixed


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few enough rows and bytes that long texts do not fill a worker; a lower setting is kept."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        size = int(now[:-1]) if now and now[:-1].isdigit() and now.endswith("b") else int(now) if now and now.isdigit() else None
        if size is None or size > most:
            spark.conf.set(name, str(most))


def release(spark: SparkSession) -> None:
    """Let go of shuffle files behind a checkpoint: Spark deletes those of plans that the driver no longer refers to, but
    only when its garbage is collected, which may be long after the disk is full."""
    for _ in range(2):  # plans refer to each other over the border of Python and the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
