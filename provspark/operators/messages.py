"""Message streams of exports: captions of albums, photo/post pairs across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.scan import scan


def carry_caption(messages: DataFrame) -> DataFrame:
    """The last non-empty text of a channel carries to later empty messages of the same timestamp.

    Messages posted by a bot still set the carried text and are dropped afterwards.
    """
    own = F.when(F.col("text") != "", F.struct("ts", "text"))
    carried = scan(messages, ["channel"], "msg", {"_last": ("last", own)})
    text = F.when(F.col("text") != "", F.col("text")).when(
        F.col("_last.ts") == F.col("ts"), F.col("_last.text")
    ).otherwise("")
    return carried.where(~F.col("via_bot")).withColumn("text", text).drop("_last")


def pair_tokens(tokens: DataFrame, page: str = "page", position: str = "pos") -> DataFrame:
    """A photo pairs with the next post link and is used once; the last photo before the post counts.

    Tokens (page, pos, kind, value) in page order; a waiting photo survives the page break. A post has a partner iff a
    photo stands between it and the post before it, which two running maxima over the token order decide.
    """
    place = F.struct(page, position)
    photo = F.when(F.col("kind") == "photo", F.struct(place.alias("at"), F.col("value").alias("value")))
    post = F.when(F.col("kind") == "post", place)
    ordered = tokens.where(F.col("kind").isin("photo", "post"))
    seen = scan(ordered, [], page, {"_photo": ("last", photo), "_post": ("last", post)}, ties=[position])
    # the post before this one: the running post excluding the row itself, read from the row before
    posts = seen.where(F.col("kind") == "post").select(page, position, "value", "_photo")
    before = scan(
        ordered.where(F.col("kind") == "post").withColumn("_here", place), [], page,
        {"_n": ("sum", F.lit(1).cast("bigint"))}, ties=[position],
    )
    numbered = before.select(page, position, "_n")
    previous = numbered.select((F.col("_n") + 1).alias("_n"), F.struct(page, position).alias("_before"))
    with_previous = numbered.join(previous, "_n", "left").select(page, position, "_before")
    joined = posts.join(with_previous, [page, position])
    fresh = F.col("_photo").isNotNull() & (F.col("_before").isNull() | (F.col("_photo.at") > F.col("_before")))
    return joined.where(fresh).select(page, position, F.col("value").alias("post"), F.col("_photo.value").alias("photo"))
