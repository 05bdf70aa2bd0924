"""Query of the token rollup: every document is inserted, English ones are counted anew, toxic ones are deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import table
from provspark.llm.registry import query
from provspark.llm.rollup import TOKENIZERS, Rollup, counted, deletes, inserts, revisions
from provspark.session import cut_lineage, scratch

SQL = f"""
WITH c AS (SELECT d.doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{TOKENIZERS["words1"]}')) AS w1,
                  len(regexp_extract_all(coalesce(text, ''), '{TOKENIZERS["words2"]}')) AS w2
           FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words2' ELSE 'words1' END AS tokenizer,
       CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN lang = 'en' THEN w2 ELSE w1 END) AS BIGINT) AS n_tokens
FROM c GROUP BY ALL
"""


@query("op3_token_counts", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rolled(docs, labels, scratch(spark, "rollup"))


def rolled(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    counts = cut_lineage(counted(docs))
    toxic = counts.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    english, other = F.coalesce(F.col("lang") == "en", F.lit(False)), F.coalesce(F.col("lang") != "en", F.lit(True))
    batches = {
        "1": inserts(counts, "words1"),
        "2": revisions(counts.where(english), "words1", "words2"),
        "3": deletes(toxic.where(english), "words2").unionByName(deletes(toxic.where(other), "words1")),
    }
    rollup = Rollup(docs.sparkSession, folder)
    for batch in ("1", "2", "3", "2"):  # the second delivery of a batch changes nothing
        rollup.commit(batch, batches[batch])
    return rollup.totals()
