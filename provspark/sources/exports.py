"""Chat exports: JSON with union-typed text, and numbered HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions.text import flatten_text

NUMBERED = r"messages(\d*)\.html$"


def html_pages(pages: DataFrame, name: str, number: str = NUMBERED) -> DataFrame:
    """Add ``page_no`` from the page name; a name without digits is page 1."""
    digits = F.regexp_extract(F.col(name), number, 1)
    return pages.withColumn("page_no", F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(1).cast("bigint")))


def read_html_export(spark: SparkSession, path: str) -> DataFrame:
    """(name, html, page_no), one row per page file."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("html"))
    return html_pages(pages, "name")


def read_chat_export(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Messages of an export: (msg, date, text, photo, file, via_bot, forwarded_from), service entries dropped.

    ``text`` may be a string or a list of strings and objects; it is read as VARIANT, so no schema is inferred. With
    ``wholetext`` off every line is an export of its own, so a large archive of exports is split between tasks.
    """
    whole = spark.read.text(path, wholetext=wholetext).select(F.parse_json("value").alias("doc"))
    entries = whole.select(
        F.try_variant_get("doc", "$.name", "string").alias("channel"),
        F.posexplode(F.try_variant_get("doc", "$.messages", "array<variant>")).alias("pos", "m"),
    )

    def field(name: str, kind: str = "string"):
        return F.try_variant_get("m", f"$.{name}", kind)

    text = F.coalesce(flatten_text(F.try_variant_get("m", "$.text", "variant")), F.lit(""))
    return entries.where(field("type") == "message").select(
        "channel",
        "pos",
        field("id", "bigint").alias("msg"),
        field("date").alias("date"),
        text.alias("text"),
        field("photo").alias("photo"),
        field("file").alias("file"),
        field("via_bot").isNotNull().alias("via_bot"),
        field("forwarded_from").alias("forwarded_from"),
    )
