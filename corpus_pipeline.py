"""From raw documents to token ids: toxic ones go, near copies go, repeated passages go, sources are mixed, texts encoded.

Each stage works on all that its predecessor kept. Rows without an id can be neither compared nor drawn: they pass every
stage. No stage can be told in SQL, so there is no oracle; the tests hold each stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.bpe import Vocabulary, round_trip
from provspark.llm.common import table
from provspark.llm.jaccard import similar
from provspark.llm.mixing import mix
from provspark.llm.mixing_query import domains
from provspark.llm.repeats import repeated_spans, without_spans
from provspark.llm.toxicity import learn, score
from provspark.llm.toxicity_query import LEAST, may_learn
from provspark.session import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Target shares of the tokens of good and poor prose, for 1.2 times the tokens there are, or as many more as it takes for
#: poor prose to be no more than its share: every document stays at least once; those of a domain that is short of its
#: target come several times, as in several epochs, up to the highest rate or what that number of tokens asks for.
WEIGHTS, SCALE, LOWEST, HIGHEST = {"good": 0.95, "poor": 0.05}, 1.2, 1.0, 4.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit; null and empty texts have no toxic words and stay."""
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), may_learn())
    return score(docs.select(*COLUMNS), model).where(F.col("score") < LEAST).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents with a five-word shingle similarity of 0.75 or more; each row once."""
    groups, _ = similar(docs)
    gone = groups.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.select(*COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that an earlier document, or the same one before, has too.

    Characters are kept or removed whole. Documents of which nothing is left go; untouched ones stay as they are.
    """
    rows = without_spans(docs.select(*COLUMNS), repeated_spans(docs), whole=True)
    text = F.when(F.col("start").isNull(), F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    chars = F.when(F.col("start").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    left = rows.withColumn("text", text).withColumn("n_chars", chars)
    return left.where(F.col("start").isNull() | (F.length("text") > 0)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    rated = mix(docs, domains(table(spark, sf_dir, "labels")), WEIGHTS, SCALE, LOWEST, HIGHEST)
    often = rated.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    times = F.sequence(F.lit(1), F.coalesce(F.col("copies"), F.lit(1)))
    return docs.select(*COLUMNS).join(often, "doc_id", "left").withColumn("epoch", F.explode(times)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to its bytes."""
    import public_tokenizers

    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = round_trip(docs.select(*COLUMNS), vocabulary, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
