"""Query of benchmark decontamination: windows of all items, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import table
from provspark.llm.decontaminate import contaminated
from provspark.llm.registry import query

WORDS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format(text="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(text="text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
        lambda i: array_to_string(w[i:i + 9], ' '))) AS t FROM b WHERE len(w) > 0),
places AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
occ AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM places),
hit AS (SELECT doc_id, i, m, item_id FROM occ JOIN win USING (m, t)),
word AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
         FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(item.ids, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""


@query("op11_decontamination", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def told(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    found = contaminated(docs.select("doc_id", "text"), benchmark, **how)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )
