"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provspark.llm.common import table
from provspark.llm.registry import query
from provspark.llm.url_rules import judge

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
                           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest FROM u),
k AS (SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
m AS (SELECT k.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC) AS n
      FROM k LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE n = 1
"""


@query("op6_url_filters", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
