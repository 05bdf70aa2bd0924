"""Query of byte-level BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.bpe import Vocabulary, round_trip
from provspark.llm.common import table
from provspark.llm.registry import query


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.read(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = round_trip(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
