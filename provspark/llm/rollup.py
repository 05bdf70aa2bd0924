"""Token totals by source, language and tokenizer version, kept up by signed changes in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: The words of each version of the counting rule, as patterns that Java and RE2 read alike.
TOKENIZERS = {"words1": r"[^\x20\x09-\x0D]+", "words2": r"[^\x20-\x2F\x09-\x0D]+"}


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, lang, one column of counts per tokenizer version); null and empty texts count 0."""
    counts = {v: F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("long") for v, p in TOKENIZERS.items()}
    return docs.select("doc_id", "source", "lang", *(c.alias(v) for v, c in counts.items()))


def inserts(rows: DataFrame, version: str) -> DataFrame:
    return _signed(rows, version, 1)


def deletes(rows: DataFrame, version: str) -> DataFrame:
    return _signed(rows, version, -1)


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """The old count goes and the new one comes."""
    return deletes(rows, old).unionByName(inserts(rows, new))


def _signed(rows: DataFrame, version: str, sign: int) -> DataFrame:
    return rows.select(
        "source", "lang", F.lit(version).alias("tokenizer"), F.lit(sign).alias("sign"), F.col(version).alias("tokens")
    )


class Rollup:
    """Totals in ``folder``, one sub-folder of summed changes per batch.

    A batch counts once its sub-folder has the writer's success mark, which comes last: one that broke off does not
    count and is written anew, one that is committed again changes nothing. Batches are added up when totals are read,
    so they may be committed in any order. Changes are summed before they are shuffled, so a hot source is one row per
    task. Null keys are groups of their own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """``changes``: source, lang, tokenizer, sign (1 or -1), tokens. False if the batch had been committed."""
        path = f"{self.folder}/batch={batch}"
        if self._exists(f"{path}/_SUCCESS"):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("long").alias("n_tokens"),
        )
        sums.write.mode("overwrite").parquet(path)
        return True

    def batches(self) -> list[str]:
        root = self._path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = sorted(s.getPath().toString() for s in fs.listStatus(root))
        return [p for p in found if self._exists(f"{p}/_SUCCESS")]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches, without keys whose totals are zero."""
        read = [self.spark.read.parquet(p) for p in self.batches()]
        if not read:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = reduce(DataFrame.unionByName, read).groupBy(*KEYS)
        return sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
            "n_docs <> 0 or n_tokens <> 0"
        )

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
