"""Where a detector misses or errs: bins, quarters, tags, strata, duplicate groups, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.hashing import hash60
from provspark.operators.metrics import auc_two_sided
from provspark.operators.ranks import average_ranks, exact_quantiles
from provspark.operators.sampling import first_n, first_occurrence

SPLITS = ["train", "val", "test"]


def rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def source_split_table(df: DataFrame) -> DataFrame:
    """Rows per source and split plus distinct groups."""
    counts = df.groupBy("source").pivot("split", SPLITS).count().fillna(0, SPLITS)
    return counts.join(df.groupBy("source").agg(F.countDistinct("grp").alias("creators")), "source")


def rating_mix(df: DataFrame, source: str = "source", rating: str = "rating") -> DataFrame:
    counts = df.where(F.col(rating) >= 0).groupBy(source, rating).agg(F.count("*").alias("n"))
    totals = counts.groupBy(source).agg(F.sum("n").alias("_all"))
    return counts.join(totals, source).select(source, rating, "n", (F.col("n") / F.col("_all")).alias("share"))


def distinct_group_rate(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Share of duplicate groups with any flagged member, beside the share of rows."""
    groups = df.groupBy(group).agg(F.max(F.col(flag).cast("int")).alias("f"), F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("k"))
    return groups.agg(
        F.avg(F.col("f").cast("double")).alias("group_rate"),
        (F.sum("k") / F.sum("n")).alias("row_rate"),
        F.count("*").alias("n_groups"),
    )


def category_breakdown(df: DataFrame, category: str, group: str, order: str, flag: str) -> DataFrame:
    """Flagged posts and flagged distinct images per category; an image counts where its first flagged post stands."""
    flagged = df.where(F.col(flag))
    posts = flagged.groupBy(category).agg(F.count("*").alias("posts"))
    images = first_occurrence(flagged.select(group, order, category), [group], order).groupBy(category).agg(
        F.count("*").alias("images")
    )
    (total,) = df.agg(F.countDistinct(group)).first()
    joined = posts.join(images, category, "left").fillna(0, ["images"])
    return joined.withColumn("share", F.col("images") / F.lit(total))


def binned_rate(df: DataFrame, value: str, edges: Sequence[float], flag: str, min_n: int = 30) -> DataFrame:
    """Rate per half-open bin [a, b); values outside all bins, and bins with few rows, drop."""
    label = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        inside = (F.col(value) >= a) & (F.col(value) < b)
        name = f"{a:g}-{b:g}"
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return (
        df.withColumn("bin", label)
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count("*").alias("n"), rate(flag).alias("rate"))
        .where(F.col("n") >= min_n)
    )


def split_medians(df: DataFrame, flag: str, covariates: Sequence[str]) -> DataFrame:
    """Median of every covariate for flagged and other rows; missing values are ignored."""
    pairs = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value")) for c in covariates])
    tall = df.select(flag, F.explode(pairs).alias("p")).select(flag, "p.*")
    return exact_quantiles(tall, [flag, "covariate"], "value", [0.5]).withColumnRenamed("q0", "median")


def grouped_rate(df: DataFrame, key: str, flag: str, min_n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), rate(flag).alias("rate")).where(F.col("n") >= min_n)


def tag_lift(df: DataFrame, tags: str, flag: str, min_n: int = 60, top: int = 30, bottom: int = 15) -> DataFrame:
    """Tags with the highest and the lowest rate."""
    tall = df.select(F.explode(F.array_distinct(tags)).alias("tag"), flag)
    rates = grouped_rate(tall, "tag", flag, min_n)
    high = rates.orderBy(F.desc("rate"), "tag").limit(top).withColumn("end", F.lit("high"))
    low = rates.orderBy("rate", "tag").limit(bottom).withColumn("end", F.lit("low"))
    return high.unionByName(low)


def strata_fpr(df: DataFrame, score: str, strata: str, fpr: float, min_n: int = 50) -> DataFrame:
    """False-positive rate per (possibly overlapping) stratum at one threshold over all negatives."""
    (cut,) = exact_quantiles(df, [], score, [1.0 - fpr]).select("q0").first()
    flagged = df.select(F.explode(F.array_distinct(strata)).alias("stratum"), (F.col(score) > F.lit(cut)).alias("f"))
    return grouped_rate(flagged, "stratum", "f", min_n)


def stratified_auc(df: DataFrame, stratum: str, min_n: int = 30) -> DataFrame:
    """AUC with both classes restricted to one stratum; small sides drop."""
    auc = auc_two_sided(df, [stratum])
    return auc.where((F.col("n_neg") >= min_n) & (F.col("n_pos") >= min_n))


def quartile_contrast(df: DataFrame, score: str, distance: str, fpr: float = 0.01) -> DataFrame:
    """Rank correlation of score and distance, and the rates beyond the common threshold in the outer quartiles."""
    rs, rd = average_ranks(df, [], score, "_rs"), average_ranks(df, [], distance, "_rd")
    ranked = df.join(rs.select(score, "_rs"), score).join(rd.select(distance, "_rd"), distance)
    cut = exact_quantiles(df, [], score, [1.0 - fpr]).first()["q0"]
    quarter = exact_quantiles(df, [], distance, [0.25, 0.75]).first()
    near, far = F.col(distance) < quarter["q0"], F.col(distance) > quarter["q1"]
    above = (F.col(score) > F.lit(cut)).cast("double")
    return ranked.agg(
        F.corr("_rs", "_rd").alias("rho"),
        F.avg(F.when(near, above)).alias("near_rate"),
        F.avg(F.when(far, above)).alias("far_rate"),
        F.count("*").alias("n"),
    )


def latest_decision(log: DataFrame, key: str, sequence: str, decision: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(decision, sequence).alias(decision))


def single_feature_auc(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """How well one nuisance column alone separates the classes: max(a, 1 - a)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])
    tall = df.select(label, F.explode(pairs).alias("p")).select(label, "p.*")
    auc = auc_two_sided(tall, ["feature"], label)
    return auc.withColumn("separation", F.greatest(F.col("auc"), 1.0 - F.col("auc")))


def triage_sample(df: DataFrame, keys: Sequence[str], item: str, n: int, t1: float, t5: float, seed: int = 5) -> DataFrame:
    """A fixed sample per export: size, photos, shares above both thresholds, median score of the scored rows."""
    sample = first_n(df.withColumn("_h", hash60(seed, F.col(item))), keys, "_h", n, tie=item)
    counts = sample.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.count_if(F.col("photo")).alias("photos"),
        F.avg((F.col("score") > t1).cast("double")).alias("above_1"),
        F.avg((F.col("score") > t5).cast("double")).alias("above_5"),
    )
    median = exact_quantiles(sample, keys, "score", [0.5]).select(*keys, F.col("q0").alias("median"))
    return counts.join(median, list(keys), "left")


def flag_leaders(df: DataFrame, group: str, flag: str, n: int = 10) -> DataFrame:
    return (
        df.groupBy(group)
        .agg(F.sum(F.col(flag).cast("bigint")).alias("flags"), F.count("*").alias("size"))
        .orderBy(F.desc("flags"), group)
        .limit(n)
    )


def provable_age_rates(
    df: DataFrame, source: str, age: str, flag: str, first: DataFrame | None = None, item: str = "item_id"
) -> DataFrame:
    """Pooled totals are wanted here, so grouping sets are right: every source and all, every age and all.

    ``first`` lists the items that stay where others are duplicates of them (such as the leaders of ``leader_clusters``);
    the others leave before anything is counted.
    """
    if first is not None:
        df = df.join(first.select(item), item, "left_semi")
    sums = [F.count("*").alias("n"), F.sum(F.col(flag).cast("bigint")).alias("flags"), rate(flag).alias("fpr")]
    out = df.cube(source, age).agg(*sums)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("all")) for c in (source, age)})


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Element-wise mean of several vectors per key, as (keys, dim, value)."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("value")
    )


def feature_moments(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation per dimension; the variance has a floor of 1e-12."""
    x = F.col("x").cast("double")
    return df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(
        F.avg(x).alias("mean"), F.sqrt(F.greatest(F.var_pop(x), F.lit(1e-12))).alias("scale")
    )
