"""Feature tables: aligned backbones, inference in batches, content-keyed caches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.session import bounded_batches


def read_features(path_or_df, backbone: str | None = None, variant: str | None = None) -> DataFrame:
    """Rows of one backbone and variant; with a partitioned table only those folders are read."""
    df = path_or_df
    if backbone is not None:
        df = df.where(F.col("backbone") == backbone)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    return df


def align_features(parts: Mapping[str, DataFrame], item: str = "item_id") -> DataFrame:
    """Items present in all backbones, their vectors joined in the given order."""
    out, names = None, []
    for name, df in parts.items():
        part = df.select(item, F.col("vec").alias(f"_{name}"))
        out = part if out is None else out.join(part, item)
        names.append(f"_{name}")
    return out.select(item, F.concat(*names).alias("vec"))


def extract_features(
    df: DataFrame, content: str, make_predict: Callable[[], Callable], dim: int, batch: int = 32, item: str = "item_id"
) -> DataFrame:
    """Fixed-length vectors from the caller's batch model; Spark partitions the rows, the model loads once per worker.

    Rows without content have no vector; one of another length is an error.
    """
    bounded_batches(df.sparkSession)
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=None
    )
    found = df.where(F.col(content).isNotNull()).select(item, predict(F.col(content)).alias("vec"))
    other = F.raise_error(F.concat(F.lit(f"the model gave no vector of {dim}: "), F.size("vec").cast("string")))
    return found.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(other))


def trigram_model(dim: int) -> Callable[[], Callable]:
    """A stand-in for a backbone: hashed character trigram counts of the whole text."""

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                c = np.frombuffer(str(text).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                if len(c) >= 3:
                    out[row] = np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % dim, minlength=dim)
            return out

        return predict

    return make


def missing_groups(groups: DataFrame, cache: DataFrame, keys: Sequence[str] = ("detector", "group_key")) -> DataFrame:
    """Groups whose content key has no cached result yet; only these are computed again."""
    return groups.join(cache.select(*keys).distinct(), list(keys), "left_anti")
