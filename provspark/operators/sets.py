"""Unions of packs and set overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators.sampling import cap_random


def union_packs(packs: Mapping[str, DataFrame]) -> DataFrame:
    """Several packs as one; fields a pack lacks are null."""
    out = None
    for name, df in packs.items():
        part = df.withColumn("pack", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_groups(packs: Mapping[str, DataFrame], group: str, item: str, n: int, seed: int) -> DataFrame:
    """Groups of the same name from several packs are joined before they are capped."""
    return cap_random(union_packs(packs), [group], item, n, seed)


def overlap(tags: Column, terms: Sequence[str]) -> Column:
    return F.array_intersect(tags, F.array(*[F.lit(t) for t in terms]))
