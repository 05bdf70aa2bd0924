"""Manifest rows in, decisions out: ordered rules with recorded reasons, policy erasure, block lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import text as X
from provspark.operators.sampling import first_occurrence, quota
from provspark.session import bounded_batches

# Reason codes as they stand in manifests.
REASONS = {
    "small": "zu klein",
    "photo": "foto",
    "policy": "gesperrt",
    "style": "stil: ",
    "quota": "nutzer-limit",
    "error": "fehler",
    "duplicate": "dublette: ",
    "tool": "ki-werkzeug in der fusszeile",
}
# Limits of the rules.
MIN_SIDE = 512
PHOTO_AT = 0.75


def min_side(w: Column, h: Column, limit: int = MIN_SIDE) -> Column:
    return F.greatest(w, h) >= limit


def first_reason(rules: Sequence[tuple[str | Column, Column]]) -> Column:
    """The reason of the first rule that holds; null = admitted. A null condition does not hold."""
    parts = [F.when(cond, reason if isinstance(reason, Column) else F.lit(reason)) for reason, cond in rules]
    return F.coalesce(*parts)


def admit(df: DataFrame, rules: Sequence[tuple[str | Column, Column]], name: str = "reason") -> DataFrame:
    return df.withColumn(name, first_reason(rules))


def rule_book(policy: Mapping[str, Sequence[str]], photo_medium: str = "photo") -> dict[str, tuple]:
    """Single rules over the candidate columns w, h, real_score, tags, text, rating."""
    tags, blocked = F.col("tags"), policy.get("tags", ())
    entities = F.size(X.policy_entities(F.col("text"), policy.get("entities", ()), policy.get("series", ()))) > 0
    style = X.keep_known_tags(tags, policy.get("style", ()))
    return {
        "small": (REASONS["small"], ~min_side(F.col("w"), F.col("h"))),
        "photo": (REASONS["photo"], F.col("real_score") >= PHOTO_AT),
        "words": (REASONS["policy"], F.size(X.policy_words(F.col("text"), policy.get("words", ()))) > 0),
        "policy": (
            REASONS["policy"],
            (F.size(X.policy_tags(tags, blocked)) > 0) | (X.restricted_rating(F.col("rating")) & entities),
        ),
        "tags": (REASONS["policy"], F.size(X.policy_tags(tags, blocked)) > 0),
        "style": (F.concat(F.lit(REASONS["style"]), F.array_join(style, ",")), F.size(style) > 0),
        "medium": (F.lit(REASONS["style"] + photo_medium), F.array_contains(tags, photo_medium)),
        "tool": (REASONS["tool"], X.names_tool(F.col("text"), policy.get("tools", ("$^",)))),
    }


# Rule order by kind of source; cheap column rules come before text rules wherever the order allows it.
CASCADES = {
    "web": ("small", "photo", "tags", "style"),
    "prompted": ("words", "photo", "policy", "medium"),
    "footer": ("tool", "photo", "policy"),
}


def admit_cascade(df: DataFrame, kind: str, policy: Mapping[str, Sequence[str]]) -> DataFrame:
    bounded_batches(df.sparkSession)  # the rules on texts run in Python
    book = rule_book(policy)
    return admit(df, [book[r] for r in CASCADES[kind]])


def admit_with_quota(
    df: DataFrame, kind: str, policy: Mapping[str, Sequence[str]], n: int, prior: DataFrame | None = None,
    creator: str = "creator", arrival: str = "item_id",
) -> DataFrame:
    """Quota before all other rules, counting stored rows only.

    Whether a slot is free depends on which earlier rows were stored, and that depends only on the other rules: decide
    those first, find the row that takes the last slot, and let the quota override every later row.
    """
    decided = admit_cascade(df, kind, policy)
    flagged = quota(decided, [creator], arrival, n, counts=F.col("reason").isNull(), prior=prior)
    return flagged.withColumn(
        "reason", F.when(F.col("over_quota"), F.lit(REASONS["quota"])).otherwise(F.col("reason"))
    ).drop("over_quota")


def admit_unique(df: DataFrame, kind: str, policy: Mapping[str, Sequence[str]], content: str, arrival: str) -> DataFrame:
    """Only the first row of each content key is decided; later copies leave no row at all."""
    return admit_cascade(first_occurrence(df, [content], arrival), kind, policy)


def readmit_style(df: DataFrame, policy: Mapping[str, Sequence[str]], name: str = "reason") -> DataFrame:
    """Style-inverted pass: rows rejected for style only are wanted now; everything else keeps its reason."""
    bounded_batches(df.sparkSession)
    styled = F.col(name).startswith(REASONS["style"].split(":")[0])
    return df.where(styled).withColumn(name, rule_reason(policy))


def rule_reason(policy: Mapping[str, Sequence[str]]) -> Column:
    book = rule_book(policy)
    return first_reason([book["small"], book["photo"], book["policy"]])


def admission_funnel(df: DataFrame, source: str = "source", reason: str = "reason") -> DataFrame:
    family = F.split_part(F.coalesce(F.col(reason), F.lit("ok")), F.lit(":"), F.lit(1))
    return df.groupBy(source, family.alias("family")).agg(F.count("*").alias("n"))


def kept(df: DataFrame, path: str = "path", reason: str = "reason") -> DataFrame:
    """A row counts iff it has a file and no reason."""
    return df.where(F.col(path).isNotNull() & F.col(reason).isNull())


def tombstone(
    df: DataFrame, hits: DataFrame, key: str, keep: Sequence[str], reason: str, paths: Sequence[str] = ("path",),
    probe: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Erase rows that are hit and not yet rejected: key columns and the reason stay, all else becomes null.

    Returns the new table and the removed paths. With ``probe`` nothing is erased; the hit is only marked.
    """
    marked = df.join(hits.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(False)) & F.col("reason").isNull()
    )
    removed = (
        marked.where("_hit").select(F.explode(F.array(*paths)).alias("path")).where(F.col("path").isNotNull()).distinct()
    )
    if probe:
        return marked.withColumnRenamed("_hit", "policy_hit"), removed
    columns = []
    for c in df.columns:
        if c == key or c in keep:
            columns.append(F.col(c))
        elif c == "reason":
            columns.append(F.when(F.col("_hit"), F.lit(reason)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.when(~F.col("_hit"), F.col(c)).alias(c))
    return marked.select(*columns), removed


def erase_policy_hits(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows rejected by policy keep their key columns and the reason only."""
    hit = F.coalesce(F.col("reason") == REASONS["policy"], F.lit(False))
    return df.select(
        *[F.col(c) if c in keep or c == "reason" else F.when(~hit, F.col(c)).alias(c) for c in df.columns]
    )


# --- block lists ----------------------------------------------------------------------------------------------------


def normalise_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    return (
        paths.select(F.lower(F.trim(F.col(path))).alias("path_lc"))
        .where((F.col("path_lc") != "") & F.col("path_lc").isNotNull())
        .distinct()
    )


def apply_blocklist(df: DataFrame, blocked: DataFrame, path: str = "path") -> DataFrame:
    """Drop listed paths, any case. No broadcast hint: the planner broadcasts only a list it knows to be small."""
    return df.withColumn("path_lc", F.lower(F.col(path))).join(blocked.select("path_lc"), "path_lc", "left_anti").drop(
        "path_lc"
    )


def valid_items(items: DataFrame, blocked: DataFrame, mislabelled: DataFrame) -> DataFrame:
    usable = items.where(F.col("readable") & ~F.contains(F.col("path"), F.lit("_thumb.")))
    return apply_blocklist(apply_blocklist(usable, blocked), mislabelled)


def select_items(items: DataFrame, **wanted: Sequence) -> DataFrame:
    for column, values in wanted.items():
        items = items.where(F.col(column).isin(*values))
    return items


def all_paths(manifests: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        manifests.select(F.explode(F.array(*columns)).alias("path")).where(F.col("path").isNotNull()).distinct()
    )


def reconcile_blocklist(blocked: DataFrame, manifests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Entries that no valid manifest row names any more."""
    live = normalise_paths(all_paths(manifests.where(F.col("reason").isNull()), columns))
    return blocked.select("path_lc").distinct().join(live, "path_lc", "left_anti")


def blocklist_union(new: DataFrame, old: DataFrame) -> DataFrame:
    """Paths to append: listed anew and not listed yet."""
    return new.select("path").subtract(old.select("path"))


def only_new(df: DataFrame, decided: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    done = decided
    if retry_errors:
        done = decided.where(~F.coalesce(F.col("reason"), F.lit("")).startswith(REASONS["error"]))
    return df.join(done.select(key).distinct(), key, "left_anti")


def require_metadata(df: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Left join that keeps rows without metadata visible: ``usable`` is false for them."""
    known = meta.withColumn("usable", F.lit(True))
    return df.join(known, key, "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def lookup(df: DataFrame, catalogue: DataFrame, key: str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Catalogue columns by key; with ``defaults`` missing rows stay and take them, otherwise they drop."""
    if defaults is None:
        return df.join(catalogue, key)
    return df.join(catalogue, key, "left").fillna(dict(defaults))


def recheck(flagged: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """What became of flagged rows: tagged by now, deleted, not found, unchanged."""
    now = current.select(key, "tagged", "deleted").withColumn("_found", F.lit(True))
    outcome = (
        F.when(F.col("_found").isNull(), "not found")
        .when(F.col("tagged"), "tagged")
        .when(F.col("deleted"), "deleted")
        .otherwise("unchanged")
    )
    return flagged.join(now, key, "left").withColumn("outcome", outcome).drop("_found", "tagged", "deleted")


def source_flags(df: DataFrame, extensions: Sequence[str], machine_tags: Sequence[str], max_id: int | None) -> DataFrame:
    """Posts that may be taken: present, right file type, no machine tag, id below the cut."""
    ok = ~F.coalesce(F.col("deleted"), F.lit(False)) & ~F.coalesce(F.col("banned"), F.lit(False))
    ok = ok & F.col("file_url").isNotNull() & F.lower(F.col("ext")).isin(*extensions)
    ok = ok & (F.size(X.policy_tags(F.col("tags"), machine_tags)) == 0)
    if max_id is not None:
        ok = ok & (F.col("item_id") < max_id)
    return df.where(ok)


def generator_mask(df: DataFrame, names: Sequence[str], source: str = "source", model: str = "model", detail: str = "detail"):
    """Rows of the named generators: exact model, or ``source:part`` = substring of the model detail in one source."""
    exact = [n for n in names if ":" not in n]
    mask = F.col(model).isin(*exact) if exact else F.lit(False)
    for name in names:
        if ":" in name:
            src, part = name.split(":", 1)
            mask = mask | ((F.col(source) == src) & F.contains(F.lower(F.coalesce(F.col(detail), F.lit(""))), F.lit(part)))
    return F.coalesce(mask, F.lit(False))


def leave_out(df: DataFrame, names: Sequence[str], **columns) -> DataFrame:
    """Rows without the named generators; an experiment whose names match nothing is an error."""
    mask = generator_mask(df, names, **columns)
    if df.where(mask).isEmpty():
        raise ValueError(f"nothing matches {list(names)}")
    return df.where(~mask)
