"""Names, prompts, dates, links and policy terms as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from provspark.functions.vectors import let
from provspark.session import bounded_batches

# Patterns whose matches must stay the same for equal results.
FILE_DATE = r"@(\d\d)-(\d\d)-(\d{4})"
RESOLUTION = r"_(\d{3,4})x(\d{3,4})"
PROMPT_VERSION = (
    r"(?i)--(v|version|niji)\s*([\d.]+|test\w*)|--(testp?)\b|"
    r"(?:version\s*midjourney|midjourney\s*(?:version|v))\s*:?\s*([\d.]+)"
)
XMP_YEAR = r"(?:CreateDate|DateTimeOriginal|DateCreated)(?:>|=\"|\x00+)\s*(\d{4})"
EXIF_YEAR = r"((?:19|20)\d\d):[01]\d:[0-3]\d [0-2]\d:\d\d:\d\d"
WORD = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
UNSAFE_NAME = r"[^A-Za-z0-9._-]+"
LINK = r"(?:https?://|t\.me/)\S+"
SOFTWARE = r"(?i)software\s+(.{2,40}?)(?:\s{2,}|©|$|wallpaper)"
# Fixed value: years outside this range are clock errors.
YEARS = (1995, 2026)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def file_date(name: Column) -> Column:
    """Date in ``...@dd-mm-yyyy...``; null when absent."""
    def part(i: int) -> Column:
        return F.regexp_extract(name, FILE_DATE, i)

    return F.try_to_timestamp(
        F.when(part(3) != "", F.concat_ws("-", part(3), part(2), part(1))), F.lit("yyyy-MM-dd")
    ).cast("date")


def quarter_label(day: Column) -> Column:
    return F.when(day.isNull(), "?").otherwise(
        F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    )


def parse_resolution(name: Column) -> Column:
    """Width in ``_WxH``, 0 when absent."""
    return F.coalesce(F.nullif(F.regexp_extract(name, RESOLUTION, 1), F.lit("")).cast("int"), F.lit(0))


def prompt_version(text: Column) -> Column:
    """Generator version named by the first parameter in a prompt: v5.2, niji6, test, testp, or empty."""
    kind, number, test, prose = (F.lower(F.regexp_extract(text, PROMPT_VERSION, i)) for i in (1, 2, 3, 4))
    return (
        F.when(test != "", test)
        .when(prose != "", F.concat(F.lit("v"), prose))
        .when(kind == "niji", F.concat(F.lit("niji"), number))
        .when(kind != "", F.concat(F.lit("v"), number))
        .otherwise("")
    )


def version_bucket(version: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(version, F.lit(""))))
    major = F.regexp_extract(v, r"^v?(\d+)", 1)
    return (
        F.when(v == "", "none")
        .when(v.contains("niji"), "niji")
        .when(v.startswith("test"), "test")
        .when(major != "", F.concat(F.lit("v"), major))
        .otherwise(v)
    )


def earliest_year(content: Column) -> Column:
    """Smallest plausible year among the date markers of a header; pass bytes decoded as ISO-8859-1."""
    found = F.concat(
        F.regexp_extract_all(content, F.lit(XMP_YEAR), F.lit(1)), F.regexp_extract_all(content, F.lit(EXIF_YEAR), F.lit(1))
    )
    years = F.transform(found, lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: (y >= YEARS[0]) & (y <= YEARS[1])))


def era(day: Column, cutoff: str, recent: str) -> Column:
    return (
        F.when(day.isNull(), "undated")
        .when(day < F.lit(cutoff).cast("date"), "provable")
        .when(day < F.lit(recent).cast("date"), "transition")
        .otherwise("recent")
    )


def slug(name: Column) -> Column:
    return F.regexp_replace(name, UNSAFE_NAME, "_")


def path_part(path: Column, position: int) -> Column:
    """Path component, counted from the end with negative positions."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.try_element_at(parts, F.lit(position))


def numeric_stem(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|[/\\])(\d+)\.[^./\\]+$", 1), F.lit("")).cast("bigint")


def footer_software(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, SOFTWARE, 1))


def names_tool(text: Column, words: Sequence[str]) -> Column:
    """True when a text names one of the given tools (regular expressions, any case)."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(words))


def decode_code(code: Column, names: Mapping[int, str], default: str = "?") -> Column:
    pairs = [part for k, v in names.items() for part in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def pseudonymise(text: Column, labels: Mapping[str, str], names: Mapping[str, str] | None = None) -> Column:
    """Replace names by neutral labels, longest first: ``names`` wherever they stand, then the keys of ``labels`` only as
    whole words or path parts."""
    for name in sorted(names or {}, key=lambda n: -len(n)):
        text = F.replace(text, F.lit(name), F.lit(names[name]))
    for name in sorted(labels, key=lambda n: (-len(n), n)):
        replacement = labels[name].replace("\\", r"\\").replace("$", r"\$")
        text = F.regexp_replace(text, rf"(?<![\w/]){re.escape(name)}(?![\w/])", replacement)
    return text


def split_tags(tags: Column) -> Column:
    return F.filter(F.split(F.coalesce(tags, F.lit("")), r"\s+"), lambda t: t != "")


def keep_known_tags(tags: Column, vocabulary: Sequence[str]) -> Column:
    return F.array_sort(F.array_intersect(tags, _strings(vocabulary)))


def families(tags: Column, mapping: Mapping[str, str], untagged: str, other: str) -> Column:
    """Families of the known tags; a row without tags, or with none known, gets its own label."""
    pairs = [part for k, v in mapping.items() for part in (F.lit(k), F.lit(v))]
    lookup = F.create_map(*pairs)
    known = F.array_distinct(
        F.filter(F.transform(tags, lambda t: F.try_element_at(lookup, t)), lambda f: f.isNotNull())
    )
    return (
        F.when(F.size(tags) == 0, F.array(F.lit(untagged)))
        .when(F.size(known) == 0, F.array(F.lit(other)))
        .otherwise(known)
    )


def category_cascade(
    tag_scores: Column, rules: Sequence[tuple[str, Mapping[str, float]]], gates: Mapping[str, Column], other: str
) -> Column:
    """First category with a tag at or above its limit; a gate column may decide for its category as well."""
    out = None
    for name, limits in rules:
        hit = F.coalesce(gates.get(name, F.lit(False)), F.lit(False))
        for tag, limit in limits.items():
            hit = hit | (F.coalesce(F.try_element_at(tag_scores, F.lit(tag)), F.lit(0.0)) >= limit)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


# --- policy ---------------------------------------------------------------------------------------------------------


def policy_tags(tags: Column, terms: Sequence[str]) -> Column:
    """Blocked tags among the tags, sorted; at every rating."""
    return F.array_sort(F.array_intersect(tags, _strings(terms)))


def policy_scores(tag_scores: Column, terms: Sequence[str], limit: float = 0.2) -> Column:
    sure = F.map_filter(tag_scores, lambda _, p: p >= limit)
    return F.array_sort(F.array_intersect(F.map_keys(sure), _strings(terms)))


def normalised(text: Column) -> Column:
    """Lower case, hash and underscore as blanks, double blanks halved once, padded."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.replace(F.replace(F.replace(t, F.lit("#"), F.lit(" ")), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.concat(F.lit(" "), t, F.lit(" "))


def restricted_rating(rating: Column, unknown: bool = True) -> Column:
    """Whether the entity rule applies: any rating other than general; ``unknown`` decides for missing ones."""
    return F.when(rating.isNull(), F.lit(unknown)).otherwise(~F.lower(rating.cast("string")).isin("general", "g"))


def terms_in(text: Column, names: Mapping[str, str]) -> Column:
    """Names of the spellings that occur in a text, sorted, each once; overlapping ones too.

    One automaton of all spellings steps over each text once, however many there are; the plan holds no expression per
    term. An empty spelling occurs in every text.
    """
    if not names:
        return F.array().cast("array<string>")
    session = SparkSession.getActiveSession()
    if session is not None:
        bounded_batches(session)
    everywhere = {names[s] for s in names if not s}
    spelled = tuple((s, n) for s, n in names.items() if s)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for spelling, name in spelled:
            automaton.add_word(spelling, name)
        automaton.make_automaton()
        for batch in batches:
            yield batch.map(lambda t: sorted(everywhere.union(n for _, n in automaton.iter(t)) if spelled else everywhere))

    found.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(found, "array<string>")(F.coalesce(text, F.lit("")))


def policy_entities(text: Column, entities: Sequence[str], series: Sequence[str] = ()) -> Column:
    """Entities and series that occur anywhere in the normalised text."""
    return terms_in(normalised(text), {t: t for t in [*entities, *series]})


def policy_words(prompt: Column, terms: Sequence[str]) -> Column:
    """Terms that occur as whole words or word sequences."""
    lowered = F.replace(F.lower(F.coalesce(prompt, F.lit(""))), F.lit("_"), F.lit(" "))
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    return terms_in(words, {" " + t.replace("_", " ") + " ": t for t in terms})


def credit_exempt(text: Column, credit: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(credit)


def ad_signals(
    text: Column,
    tags: Column,
    channel: Column,
    words: str,
    announcements: str,
    graphic: Sequence[str],
    credit: str,
    own: Sequence[str] = (),
) -> Column:
    """Reasons why a post looks like an advertisement; empty for credited posts."""
    t = F.coalesce(text, F.lit(""))

    def foreign_to(slug6: Column) -> Column:
        def foreign(link: Column) -> Column:
            mine = F.contains(F.replace(F.lower(link), F.lit("_"), F.lit("")), slug6)
            for name in own:
                mine = mine | F.contains(link, F.lit(name))
            return ~mine

        return F.filter(F.regexp_extract_all(t, F.lit(LINK), F.lit(0)), foreign)

    links = let(F.substring(F.lower(F.replace(channel, F.lit("_"), F.lit(""))), 1, 6), foreign_to)
    drawn = keep_known_tags(tags, graphic)
    reasons = F.array_compact(
        F.array(
            F.when(t.rlike(words) | t.rlike(announcements), F.lit("text")),
            F.when(F.size(links) > 0, F.lit("link")),
            F.when(F.size(drawn) > 0, F.concat(F.lit("image:"), F.array_join(drawn, "+"))),
        )
    )
    return F.when(credit_exempt(text, credit), F.array().cast("array<string>")).otherwise(reasons)


def flatten_text(union: Column) -> Column:
    """Message text that is a string, or a list of strings and objects with a ``text`` field (VARIANT)."""
    return F.when(
        F.schema_of_variant(union).startswith("ARRAY"),
        F.array_join(
            F.transform(
                F.try_variant_get(union, "$", "array<variant>"),
                lambda x: F.coalesce(
                    F.try_variant_get(x, "$.text", "string"),
                    F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
                    F.lit(""),
                ),
            ),
            "",
        ),
    ).otherwise(F.coalesce(F.try_variant_get(union, "$", "string"), F.lit("")))


# Luminance quantisation table of the IJG scale, natural order.
JPEG_BASE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]


def jpeg_quality(table: Column) -> Column:
    """Quality estimate from a 64-entry quantisation table; null for any other length."""
    base = F.array(*[F.lit(float(b)) for b in JPEG_BASE])
    scaled = F.array_sort(F.zip_with(table, base, lambda q, b: q.cast("double") / b * 100.0))
    s = (F.get(scaled, F.lit(31)) + F.get(scaled, F.lit(32))) / 2.0
    return F.when(F.size(table) == 64, F.when(s <= 100, 100.0 - s / 2.0).otherwise(5000.0 / s))


def available_prefix(backbones: Sequence[str], present: Column) -> Column:
    """Longest run of backbones, from the first, that are all present."""
    ordered = _strings(backbones)
    gap = F.array_position(F.transform(ordered, lambda b: F.array_contains(present, b)), F.lit(False))
    return F.when(gap == 0, ordered).otherwise(F.slice(ordered, F.lit(1), F.greatest(gap - 1, F.lit(0)).cast("int")))


def quarter_windows(start: Column, end: Column) -> Column:
    """Start dates of the three-month windows from ``start`` up to and including ``end``."""
    return F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 3 months"))
