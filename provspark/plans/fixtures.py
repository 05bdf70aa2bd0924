"""Derived views over the given tables, in SQL that Spark and DuckDB both accept.

Every view covers its whole table. Attributes the tables lack (sizes, ratings, creators) are computed from row content.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    # one row per item, as packed: label 0 human / 1 machine, nullable creator, rating -1 unrated .. 3
    "items": """
        SELECT d.doc_id AS item_id, d.source AS source, d.lang AS model,
               CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END AS label,
               CASE WHEN l.toxic = 1 THEN NULL
                    ELSE concat(d.source, ':', CAST(d.n_chars % 37 AS STRING)) END AS creator,
               CAST(d.n_chars % 5 - 1 AS INT) AS rating,
               CAST(d.n_chars % 2000 AS INT) AS w, CAST((d.n_chars * 7) % 1500 AS INT) AS h,
               d.n_chars >= 40 AS readable,
               concat('DATA/', d.source, '/channel/', CAST(d.doc_id AS STRING),
                      CASE WHEN d.n_chars < 400 THEN '_thumb.jpg' ELSE '.jpg' END) AS path,
               concat('lang_', d.lang, ' rating_', CAST(d.n_chars % 5 AS STRING),
                      CASE WHEN d.n_chars > 3000 THEN ' long' ELSE ' short' END,
                      CASE WHEN l.toxic = 1 THEN ' toxic' ELSE '' END,
                      CASE WHEN l.quality = 1 THEN ' good' ELSE '' END) AS tag_string,
               CAST(d.n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS real_score,
               COALESCE(l.toxic, 0) AS toxic, COALESCE(l.quality, -1) AS quality, d.n_chars AS n_chars, d.text AS text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # two runs of scores over the same items; machine groups are shifted up
    "scores": """
        SELECT event_id AS item_id, event_type AS grp,
               CASE WHEN event_type IN ('view', 'click', 'signup')
                    THEN CASE WHEN user_id % 2 = 0 THEN 'm_val' ELSE 'm_test' END
                    WHEN event_type = 'purchase' THEN 'k_gen' ELSE 'k_kanal' END AS kind,
               'd1' AS detector, user_id AS user_id, ts AS ts,
               round(value / CAST(20 AS DOUBLE) + CASE WHEN event_type IN ('purchase', 'error')
                     THEN CAST(6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS score
        FROM events""",
    # d1 as is, d2 tie-heavy, d3 at its maximum for most rows
    "detectors": """
        SELECT s.item_id, s.grp, s.kind, d.detector, s.user_id,
               CASE d.detector WHEN 'd1' THEN s.score WHEN 'd2' THEN CAST(floor(s.score) AS DOUBLE)
                    ELSE CASE WHEN s.score > CAST(2 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE s.score / CAST(4 AS DOUBLE) END
               END AS score
        FROM scores s, (SELECT 'd1' AS detector UNION ALL SELECT 'd2' UNION ALL SELECT 'd3') d""",
    "messages": """
        SELECT user_id AS channel, event_id AS msg, date_trunc('hour', ts) AS ts,
               CASE WHEN value < CAST(60 AS DOUBLE) THEN props ELSE '' END AS text, event_type = 'error' AS via_bot
        FROM events""",
    # file names as exports write them, some undated, some without resolution
    "files": """
        SELECT o_orderkey AS file_id, o_custkey AS owner, o_orderstatus AS source, o_totalprice AS size,
               CAST(o_orderdate AS DATE) AS day,
               concat('photo_', CAST(o_orderkey AS STRING),
                 CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE concat('@',
                   lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'),
                   '-', CAST(year(o_orderdate) AS STRING), '_10-11-12') END,
                 CASE WHEN o_orderpriority = '5-LOW' THEN ''
                      ELSE concat('_', CAST(o_custkey % 3000 + 1500 AS STRING), 'x1080') END, '.jpg') AS name
        FROM orders""",
    "prompts": """
        SELECT doc_id, n_chars, concat(text, CASE n_chars % 8 WHEN 0 THEN ' --v 5.2' WHEN 1 THEN ' --niji 6'
                 WHEN 2 THEN ' --testp' WHEN 3 THEN ' Version Midjourney: 4' WHEN 4 THEN ' --version 6'
                 WHEN 5 THEN ' midjourney v3.1' WHEN 6 THEN ' --v test --v 4' ELSE '' END) AS text
        FROM documents""",
    "features": """
        SELECT vec_id AS item_id, label AS grp, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, embedding
        FROM embeddings""",
}


def _needs(sql: str) -> list[str]:
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    out: list[str] = []
    for name in used:
        for inner in [*_needs(VIEWS[name]), name] if name not in ("items",) else [name]:
            if inner not in out:
                out.append(inner)
    return out


def with_views(sql: str) -> str:
    """Put the definitions of the views that ``sql`` uses in front of it."""
    needed = _needs(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    rest = ",\n" + body[match.end():] if match else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _detectors(scores: DataFrame) -> DataFrame:
    """The three runs by explode, so the rows are read once and nothing is paired."""
    s = F.col("score")
    runs = {"d1": s, "d2": F.floor(s).cast("double"), "d3": F.when(s > 2.0, F.lit(1.0)).otherwise(s / 4.0)}
    pairs = F.array(*[F.struct(F.lit(d).alias("detector"), v.alias("score")) for d, v in runs.items()])
    return scores.select("item_id", "grp", "kind", "user_id", F.explode(pairs).alias("r")).select(
        "item_id", "grp", "kind", "r.detector", "user_id", "r.score"
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; nothing is registered in the catalogue."""
    if name == "detectors":
        return _detectors(view(spark, sf_dir, "scores"))
    sql = VIEWS[name]
    inputs = {}
    for other in [*TABLES, *VIEWS]:
        if other == name or not re.search(rf"(FROM|JOIN)\s+{other}\b", sql):
            continue
        inputs[other] = view(spark, sf_dir, other) if other in VIEWS else table(spark, sf_dir, other)
        sql = re.sub(rf"(FROM|JOIN)\s+{other}\b", rf"\1 {{{other}}}", sql)
    return spark.sql(sql, **inputs)
