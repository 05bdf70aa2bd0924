"""Query of the Merkle manifest: proofs of all documents, every second one tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import crc_mod, table
from provspark.llm.merkle import Manifest, leaf_of
from provspark.llm.registry import query

#: Levels that the SQL spells out: up to 3 ** LEVELS documents of a source, and sources.
LEVELS = 9


def _sql() -> str:
    """The nodes of each level, what stands left and right of each, and the folding, level by level."""
    part = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
    number = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    head = " || ".join([number.format("d.doc_id"), part.format("source"), part.format("lang"), number.format("n_chars")])
    out = [f"""
WITH RECURSIVE crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS c FROM documents WHERE doc_id IS NOT NULL UNION ALL
    SELECT doc_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(s[k // 9 + 1]) AS BIGINT))
                                  WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 9 * len(s)),
even AS (SELECT doc_id FROM crc WHERE k = 9 * len(s) AND c % 2 = 1),
doc AS MATERIALIZED (SELECT d.doc_id AS doc_id, coalesce('=' || source, '') AS g, sha256({head} || {part.format("text")}) AS leaf,
    sha256({head} || {part.format("CASE WHEN even.doc_id IS NULL THEN text ELSE replace(text, chr(10), '') END")}) AS bad
    FROM documents d LEFT JOIN even ON d.doc_id = even.doc_id),
pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM doc)"""]

    def tree(name: str, leaves: str) -> None:
        out.append(f"{name}0 AS MATERIALIZED ({leaves})")
        for k in range(LEVELS):
            out.append(f"""
{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) WHERE n > 1 GROUP BY g, i // 3),
{name}s{k} AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) a JOIN {name}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3
    WHERE a.n > 1 GROUP BY a.g, a.i)""")
        levels = " UNION ALL ".join(f"SELECT g, {k} AS k, d FROM {name}{k}" for k in range(LEVELS + 1))
        out.append(f"{name}top AS MATERIALIZED (SELECT g, max_by(d, k) AS d FROM ({levels}) GROUP BY g)")

    tree("t", "SELECT g, i, leaf AS d FROM pos")
    tree("u", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d FROM ttop")
    out.append("f0 AS (SELECT p.*, o.i AS o, '' AS proof, bad AS f FROM pos p JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM ttop) o USING (g))")
    n = 0
    for name, group, at in (("t", "f.g", "f.i"), ("u", "''", "f.o")):
        for k in range(LEVELS):
            out.append(f"""
f{n + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (proof, f), f.proof || coalesce(s.l || s.r, '') AS proof,
    CASE WHEN s.g IS NULL THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f
    FROM f{n} f LEFT JOIN {name}s{k} s ON s.g = {group} AND s.i = {at} // {3**k})""")
            n += 1
    return ",\n".join(out) + f"""
SELECT f.doc_id, f.leaf, t.d AS subroot, u.d AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = u.d AS verified
FROM f{n} f JOIN ttop t USING (g), utop u
"""


@query("op12_merkle", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proven(table(spark, sf_dir, "documents"))


def proven(docs: DataFrame) -> DataFrame:
    """Proofs from a table whose texts lost their line breaks where 2 divides the crc32 of the id (rows without: never)."""
    tampered = F.coalesce(crc_mod(F.col("doc_id"), 2) == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claim = F.when(tampered, leaf_of(*rest, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", leaf_of(*rest, F.col("text")).alias("leaf"), claim.alias("claim"))
    found = Manifest(leaves).proofs("claim")
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
