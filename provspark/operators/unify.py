"""One schema for the manifests of all sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.hashing import creator_key, hash_split

# Model name and label of human rows.
HUMAN_MODEL = "mensch"


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _or(*options: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options[:-1]], options[-1])


def unify(df: DataFrame, source: str, kind: str, key: str | None = None) -> DataFrame:
    """Kept rows of one source as (item_id, source, label, model, grp, split, rating, path, detail).

    Kinds: ``human`` keeps the split written at admission and groups by artist (or the row itself); ``human_pool``
    splits by artist for training; ``web`` splits by ``source:user``, model from the base model; ``prompted`` splits by
    job, else prompt, else content key; ``derived`` inherits split and group from its base row.
    ``key`` is the space of the creators, by default the source: sources with one key share it, so that a creator of both
    falls on one side of the split. Empty paths count as missing, empty reasons as none.
    """
    key = key or source
    empty = F.lit("")
    rows = df.where((F.coalesce(F.col("path"), empty) != "") & (F.coalesce(_column(df, "reason"), empty) == ""))
    user, artist = _column(rows, "user"), _column(rows, "artist")
    rating = _column(rows, "rating").cast("string")
    if kind == "web":
        rating = _or(_column(rows, "nsfw").cast("string"), rating)
    job = _or(_column(rows, "job"), _column(rows, "prompt"), _column(rows, "sha256"))
    human = creator_key(artist, F.col("item_id"))
    web = F.concat(F.lit(f"{key}:"), F.coalesce(user, F.lit("None")))
    prompted = F.concat(F.lit(f"{key}:"), job)
    label, model, grp, split = {
        "human": (
            0,
            F.lit(HUMAN_MODEL),
            F.concat(F.lit(f"{key}:"), _or(artist, F.col("item_id").cast("string"))),
            _column(rows, "split"),
        ),
        "human_pool": (0, F.lit(HUMAN_MODEL), F.concat(F.lit(f"{key}:"), human), hash_split(human, "train_pool")),
        "web": (1, F.coalesce(_column(rows, "basis"), F.lit(source)), web, hash_split(web, "web")),
        "prompted": (1, F.lit(source), prompted, hash_split(prompted, "web")),
        "derived": (1, _column(rows, "basis"), _column(rows, "grp"), _column(rows, "split")),
    }[kind]
    return rows.select(
        "item_id",
        F.lit(source).alias("source"),
        F.lit(label).alias("label"),
        model.alias("model"),
        grp.alias("grp"),
        split.alias("split"),
        rating.alias("rating"),
        "path",
        _column(rows, "detail").alias("detail"),
    )


def unify_sources(manifests: Mapping[str, tuple]) -> DataFrame:
    """``{source: (kind, manifest)}`` or ``{source: (kind, manifest, key)}`` to one table."""
    out = None
    for source, (kind, df, *key) in manifests.items():
        part = unify(df, source, kind, *key)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
