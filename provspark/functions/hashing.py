"""Deterministic keys, splits and uniform numbers from hashes, the same on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket rules of the split schemes as (modulus, first test bucket.., first val bucket..); the rest trains.
SPLIT_SCHEMES: dict[str, tuple[int, tuple[int, int], tuple[int, int]]] = {
    "web": (20, (0, 2), (2, 3)),
    "test_pool": (10, (3, 10), (0, 3)),
    "non_anime": (20, (0, 3), (3, 4)),
    "train_pool": (20, (0, 0), (0, 1)),
    "file_name": (20, (0, 2), (2, 3)),
}
# Fixed value: prefix of the key that stands in for a missing creator.
UNKNOWN = "unbekannt:"


def creator_key(creator: Column, item_id: Column) -> Column:
    return F.coalesce(F.nullif(creator, F.lit("")), F.concat(F.lit(UNKNOWN), item_id.cast("string")))


def hash_split(key: Column, scheme: str) -> Column:
    """train / val / test from crc32 of the key: all rows of one creator share a split."""
    modulus, test, val = SPLIT_SCHEMES[scheme]
    bucket = F.crc32(F.encode(key, "utf-8")) % modulus
    return (
        F.when((bucket >= test[0]) & (bucket < test[1]), "test")
        .when((bucket >= val[0]) & (bucket < val[1]), "val")
        .otherwise("train")
    )


def hash60(*parts: Column | str | int) -> Column:
    """60-bit non-negative number from md5 of the joined parts."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1)."""
    return hash60(*parts) / F.lit(float(2**60))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def group_key(item: Column) -> Column:
    """Aggregate: short cache key of the set of items in a group.

    Count, xor and sum of the item hashes combine map-side, so no task holds the list, and row order does not matter.
    """
    h = hash60("content", item)
    parts = F.concat_ws(
        "|", F.count(item).cast("string"), F.bit_xor(h).cast("string"), F.sum(h % F.lit(2**31)).cast("string")
    )
    return F.substring(F.sha1(parts), 1, 12)


def augmentation_plan(item_id: Column, seed: int) -> dict[str, Column]:
    """Edit parameters per item that do not depend on its class.

    Fixed values: the ranges and shares of the published recipe.
    """

    def u(k: str) -> Column:
        return uniform(seed, item_id, k)

    def between(k: str, lo: float, hi: float) -> Column:
        return F.lit(lo) + u(k) * F.lit(hi - lo)

    def maybe(k: str, share: float, value: Column) -> Column:
        return F.when(u(k) < share, value)

    blur = u("blur_or_sharpen")
    return {
        "scale": between("scale", 0.6, 0.95),
        "quality": F.lit(70) + F.floor(u("quality") * 26).cast("int"),
        "subsampling": F.when(u("subsampling") < 0.5, 2).otherwise(0),
        "resample": F.element_at(
            F.array(F.lit("lanczos"), F.lit("bicubic"), F.lit("bilinear")), F.floor(u("filter") * 3).cast("int") + 1
        ),
        "crop_w": maybe("crop", 0.3, between("crop_w", 0.45, 0.9)),
        "crop_h": maybe("crop", 0.3, between("crop_h", 0.45, 0.9)),
        "rescale": maybe("rescale", 0.1, between("rescale_by", 0.35, 0.6)),
        "saturation": maybe("colour", 0.2, between("saturation", 0.7, 1.4)),
        "brightness": maybe("colour", 0.2, between("brightness", 0.85, 1.15)),
        "contrast": maybe("colour", 0.2, between("contrast", 0.85, 1.2)),
        "grey": u("grey") < 0.05,
        "blur": F.when(blur < 0.08, between("blur", 0.5, 1.6)),
        "sharpen": F.when((blur >= 0.08) & (blur < 0.16), between("sharpen", 1.0, 3.0)),
        "caption": u("caption") < 0.2,
        "noise": maybe("noise", 0.15, between("noise_by", 1.5, 8.0)),
    }
