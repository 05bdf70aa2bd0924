"""Evaluation reports: comparisons of detectors, runs, conditions and pipelines on long score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.numeric import logit
from provspark.operators import metrics as M
from provspark.operators import thresholds as T
from provspark.operators.histogram import mean_of, rows_of, score_histogram, shared_points
from provspark.operators.ranks import exact_quantiles
from provspark.session import settle


def rate_of(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def group_metrics(negatives: DataFrame, positives: DataFrame, thresholds: DataFrame, min_n: int = 40) -> DataFrame:
    """Per positive group: n, AUC against the pooled negatives, TPR at 1 and 5 %, hit rate at the stored threshold."""
    points = shared_points(negatives, positives)
    auc = M.auc_by_group(negatives, positives, points=points)
    tpr = (
        M.tpr_at_fpr(negatives, positives, [0.01, 0.05], points=points)
        .groupBy("detector", "grp")
        .agg(
            F.max(F.when(F.col("target") == 0.01, F.col("tpr"))).alias("tpr_1"),
            F.max(F.when(F.col("target") == 0.05, F.col("tpr"))).alias("tpr_5"),
        )
    )
    hit = M.exceed_rate(positives, thresholds, ["detector", "grp"]).withColumnRenamed("rate", "hit")
    return hit.where(F.col("n") >= min_n).join(auc, ["detector", "grp"]).join(tpr, ["detector", "grp"])


def variant_grid(negatives: DataFrame, positives: DataFrame, variant: str, names: Sequence[str]) -> DataFrame:
    """AUC of every positive variant against every negative variant; the list of names is short and given."""
    neg = negatives.withColumnRenamed(variant, "neg_variant")
    pos = positives.withColumnRenamed(variant, "pos_variant").withColumn(
        "neg_variant", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return M.auc_by_group(neg, pos, ["neg_variant"], ["pos_variant"])


def apply_thresholds(scores: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Exceedance of every group at every given threshold, in one pass with map-side combine."""
    listed = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return scores.select(*keys, "score", listed).groupBy(*keys, "threshold").agg(M_rate().alias("rate"))


def M_rate() -> Column:
    return F.avg(M.exceeds())


def fpr_curve(negatives: DataFrame, scores: DataFrame, targets: Sequence[float], stored: float) -> DataFrame:
    """For each target: threshold, macro false positives, macro channel hits, logistic distance from the stored one."""
    thr = T.threshold_group_mean(negatives, targets)
    base = thr.where(F.col("target") == stored).select("detector", F.col("threshold").alias("_stored"))
    per_group = scores.join(thr, "detector").groupBy("detector", "target", "threshold", "kind", "grp").agg(
        mean_of(M.exceeds(), scores).alias("rate")
    )
    return (
        per_group.groupBy("detector", "target", "threshold")
        .agg(
            F.avg(F.when(F.col("kind") == "m_test", F.col("rate"))).alias("fpr"),
            F.avg(F.when(F.col("kind") == "k_kanal", F.col("rate"))).alias("channel_hit"),
        )
        .join(base, "detector")
        .withColumn("distance", 1.0 / (1.0 + F.exp(F.col("_stored") - F.col("threshold"))))
    )


def benchmark(scores: DataFrame, fpr: float) -> DataFrame:
    """Every detector under one rule, as a long metric table.

    Detectors whose scores all lie in [0, 1] are taken through the logit. Threshold: mean false-positive rate over the
    validation groups; false positives on the test groups; hits and AUC per machine group; macro rows. Everything is
    read from one histogram of the scores.
    """
    scores = score_histogram(scores)
    span = settle(
        scores.groupBy("detector").agg(((F.min("score") >= 0) & (F.max("score") <= 1)).alias("_probability"))
    )
    z = scores.join(span, "detector").withColumn(
        "score", F.when(F.col("_probability"), logit(F.col("score"), 1e-7)).otherwise(F.col("score"))
    )
    points = shared_points(z)
    thr = T.threshold_group_mean(z.where("kind = 'm_val'"), [fpr], points)
    rates = settle(M.exceed_rate(z.where("kind <> 'm_val'"), thr, ["detector", "kind", "grp"]))
    machine = z.where("kind in ('k_gen', 'k_kanal')")
    auc = settle(M.auc_by_group(z.where("kind = 'm_test'"), machine, groups=["grp", "kind"], points=points))

    def tall(df: DataFrame, metric: str, column: str) -> DataFrame:
        return df.select("detector", "grp", F.lit(metric).alias("metric"), F.col(column).alias("value"))

    human = rates.where("kind = 'm_test'")
    hits = rates.where("kind <> 'm_test'")
    kinds = ["k_gen", "k_kanal"]
    fpr_mean = human.groupBy("detector").agg(F.avg("rate").alias("rate")).withColumn("grp", F.lit("mixed"))
    tables = [
        tall(human, "fpr", "rate"),
        tall(fpr_mean, "fpr", "rate"),
        tall(hits, "hit", "rate"),
        tall(M.macro_mean(hits, "rate", kinds), "hit", "rate"),
        tall(auc, "auc", "auc"),
        tall(M.macro_mean(auc, "auc", kinds), "auc", "auc"),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def equal_fpr_compare(negatives: DataFrame, positives: DataFrame, fpr: float) -> DataFrame:
    """Every head at the threshold that gives the same mean false-positive rate: hits and AUC per group, mean hit."""
    points = shared_points(negatives, positives)
    thr = T.threshold_group_mean(negatives, [fpr], points)
    hits = positives.join(thr, "detector").groupBy("detector", "grp", "threshold").agg(
        mean_of(M.exceeds(), positives).alias("hit"), rows_of(positives).alias("n")
    )
    auc = M.auc_by_group(negatives, positives, points=points).select("detector", "grp", "auc")
    mean = hits.groupBy("detector").agg(F.avg("hit").alias("mean_hit"))
    return hits.join(auc, ["detector", "grp"]).join(mean, "detector")


def robustness_matrix(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """Per condition at one fixed threshold: hit, pooled false positives, AUC, and the false positives of every human
    group as ``fpr_groups`` (entries grp, fpr in order of the group). Columns condition, grp, label, score."""
    fixed = threshold.first()["threshold"]
    flagged = F.col("score") > F.lit(fixed)
    per_group = rows.groupBy("condition", "grp", "label").agg(F.count("*").alias("_n"), F.count_if(flagged).alias("_k"))

    def pooled(label: int) -> Column:
        mine = F.col("label") == label
        return F.sum(F.when(mine, F.col("_k"))) / F.sum(F.when(mine, F.col("_n")))

    one = F.struct(F.col("grp"), (F.col("_k") / F.col("_n")).alias("fpr"))
    rates = per_group.groupBy("condition").agg(
        pooled(1).alias("hit"), pooled(0).alias("fpr"),
        F.sort_array(F.collect_list(F.when(F.col("label") == 0, one))).alias("fpr_groups"),
    )
    return rates.join(M.auc_two_sided(rows, ["condition"]), "condition")


def calibrate(heads: DataFrame, negatives: DataFrame) -> DataFrame:
    """New thresholds at 1 and 5 %; the thresholds stored before the first calibration are kept once."""
    thr = (
        T.threshold_group_mean(negatives, [0.01, 0.05])
        .groupBy(F.col("detector").alias("tag"))
        .agg(
            F.max(F.when(F.col("target") == 0.01, F.col("threshold"))).alias("_1"),
            F.max(F.when(F.col("target") == 0.05, F.col("threshold"))).alias("_5"),
        )
    )
    return heads.join(thr, "tag").withColumns(
        {
            "thr_1_prev": F.coalesce("thr_1_prev", "thr_1"),
            "thr_5_prev": F.coalesce("thr_5_prev", "thr_5"),
            "thr_1": F.col("_1"),
            "thr_5": F.col("_5"),
        }
    ).drop("_1", "_5")


def vote(
    scores: DataFrame, voters: Mapping[str, float], candidate: int, majority: int, veto: Mapping[str, float]
) -> DataFrame:
    """Majority of the voters, then a veto by detectors that stay below their limit."""
    votes = sum(
        F.max(F.when(F.col("detector") == d, (F.col("score") > t).cast("int")).otherwise(0)) for d, t in voters.items()
    )
    stopped = F.lit(False)
    for d, t in veto.items():
        stopped = stopped | F.coalesce(
            F.max(F.when(F.col("detector") == d, F.col("score") < t)), F.lit(False)
        )
    tallied = scores.groupBy("item_id").agg(votes.alias("votes"), stopped.alias("stopped"))
    decision = (
        F.when(F.col("votes") < candidate, "none")
        .when(F.col("stopped"), "vetoed")
        .when(F.col("votes") >= majority, "high")
        .otherwise("review")
    )
    return tallied.withColumn("decision", decision)


def best_by(metrics: DataFrame, metric: str) -> DataFrame:
    """The best detector by mean over groups, and the best detector inside each group; ties go to the first name."""
    means = metrics.groupBy("detector").agg(F.avg(metric).alias(metric))

    def pick(df: DataFrame, keys: list[str]) -> DataFrame:
        top = df.groupBy(*keys).agg(F.max(metric).alias("m"))
        joined = df.join(top, keys) if keys else df.withColumn("m", F.lit(top.first()["m"]))
        return joined.where(F.col(metric) == F.col("m")).groupBy(*keys, metric).agg(F.min("detector").alias("detector"))

    overall = pick(means, []).select(F.lit("overall").alias("scope"), F.lit("*").alias("grp"), "detector", metric)
    per_group = pick(metrics, ["grp"]).select(F.lit("group").alias("scope"), "grp", "detector", metric)
    return overall.unionByName(per_group)


def seed_spread(metrics: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("n_heads"),
        F.min(metric).alias("lo"),
        F.max(metric).alias("hi"),
        F.stddev_pop(metric).alias("std"),
    )


def compare_runs(base: DataFrame, run: DataFrame, metric: str) -> DataFrame:
    """The same group metric before and after."""
    a = base.select("grp", "kind", F.col(metric).alias("before"))
    b = run.select("grp", "kind", F.col(metric).alias("after"))
    return a.join(b, ["grp", "kind"]).withColumn("delta", F.col("after") - F.col("before"))


def exclusion_summary(base: DataFrame, run: DataFrame, other: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row per left-out experiment: its own groups before and after, the change on everything else by kind.

    ``experiments`` (experiment, grp) lists the affected machine groups. Metric tables hold one row per group, so the
    sums over "all other groups" come from totals minus the affected ones, without pairing experiments with groups.
    """
    cells = (
        compare_runs(base, run, "rate")
        .join(base.select("grp", "kind", F.col("auc").alias("auc_before")), ["grp", "kind"])
        .join(run.select("grp", "kind", F.col("auc").alias("auc_after")), ["grp", "kind"])
        .join(other.select("grp", "kind", F.col("rate").alias("hit_other")), ["grp", "kind"])
    )
    machine = cells.where("kind <> 'm_test'")

    def part(kind: str, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(column))

    totals = cells.agg(
        *[F.sum(part(k, "delta")).alias(f"_s_{k}") for k in M.MACRO],
        *[F.count(part(k, "delta")).alias(f"_n_{k}") for k in M.MACRO],
        F.avg(part("m_test", "after")).alias("fpr"),
    ).first()
    own = experiments.join(machine, "grp").groupBy("experiment").agg(
        F.avg("before").alias("hit_before"),
        F.avg("after").alias("hit_after"),
        F.avg("auc_before").alias("auc_before"),
        F.avg("auc_after").alias("auc_after"),
        F.avg("hit_other").alias("hit_other"),
        *[F.coalesce(F.sum(part(k, "delta")), F.lit(0.0)).alias(f"_d_{k}") for k in M.MACRO],
        *[F.count(part(k, "delta")).alias(f"_m_{k}") for k in M.MACRO],
    )

    def rest(kind: str) -> Column:
        left = F.lit(totals[f"_n_{kind}"]) - F.col(f"_m_{kind}")
        return F.when(left > 0, (F.lit(totals[f"_s_{kind}"]) - F.col(f"_d_{kind}")) / left)

    return own.withColumns(
        {"delta_generators": rest("k_gen"), "delta_channels": rest("k_kanal"), "fpr": F.lit(totals["fpr"])}
    )


def complete_coverage(have: DataFrame, need: DataFrame, owner: str, part: str) -> DataFrame:
    """Relational division: owners that have every required part."""
    required = need.select(part).distinct()
    wanted = required.count()
    return (
        have.select(owner, part)
        .distinct()
        .join(required, part, "left_semi")
        .groupBy(owner)
        .agg(F.count("*").alias("_k"))
        .where(F.col("_k") == wanted)
        .select(owner)
    )


def merge_results(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newer entry wins, older entries fill the gaps."""
    values = [c for c in new.columns if c not in keys]
    a = new.select(*keys, F.struct(*values).alias("_new"))
    b = old.select(*keys, F.struct(*values).alias("_old"))
    merged = a.join(b, list(keys), "full").withColumn("_v", F.coalesce("_new", "_old"))
    return merged.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def ensemble_mean(scores: DataFrame, item: str, score: str) -> DataFrame:
    return scores.groupBy(item).agg(F.avg(score).alias(score))


def view_aggregate(rows: DataFrame, item: str, score: str) -> DataFrame:
    """Mean, minimum and median over several views of an item."""
    return rows.groupBy(item).agg(F.avg(score).alias("mean"), F.min(score).alias("low"), F.median(score).alias("median"))


def paired_shift(before: DataFrame, after: DataFrame, item: str, keep: Sequence[str] = ()) -> DataFrame:
    a = before.select(item, *keep, F.col("score").alias("before"))
    b = after.select(item, F.col("score").alias("after"))
    return a.join(b, item).withColumn("shift", F.col("after") - F.col("before"))


def shift_stats(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    simple = pairs.groupBy(*keys).agg(F.avg("shift").alias("mean"), F.stddev_pop("shift").alias("std"))
    median = exact_quantiles(pairs, keys, "shift", [0.5]).withColumnRenamed("q0", "median")
    return simple.join(median, list(keys))


def ranked_report(metrics: DataFrame, metric: str, name: str) -> DataFrame:
    """One row per detector, so the ordering window is as small as the report."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col(metric).desc(), F.col(name)))
    return metrics.withColumn("place", place).orderBy("place")


def pipeline_rates(
    scores: DataFrame, gate: DataFrame, thresholds: DataFrame, review: float, auto: float, strict: bool = False
) -> DataFrame:
    """Flagged raw, left after the gate, acted on automatically; all over n. A score at a threshold counts as flagged
    unless ``strict``."""
    cuts = thresholds.groupBy("detector").agg(
        F.max(F.when(F.col("target") == review, F.col("threshold"))).alias("_review"),
        F.max(F.when(F.col("target") == auto, F.col("threshold"))).alias("_auto"),
    )
    gated = gate.select("item_id").distinct().withColumn("_gated", F.lit(True))
    rows = scores.join(gated, "item_id", "left").join(cuts, "detector")

    def reaches(limit: str) -> Column:
        return F.col("score") > F.col(limit) if strict else F.col("score") >= F.col(limit)

    flagged = reaches("_review")
    passed = flagged & F.col("_gated").isNull()
    return rows.groupBy("detector").agg(
        F.count("*").alias("n"),
        rate_of(flagged).alias("raw"),
        rate_of(passed).alias("gated"),
        rate_of(passed & reaches("_auto")).alias("auto"),
    )


def combined_throughput(speeds: DataFrame, speed: str) -> DataFrame:
    return speeds.agg((1.0 / F.sum(1.0 / F.col(speed))).alias("combined"))


def scan_report(rows: DataFrame, t1: float, t5: float) -> DataFrame:
    """Counters of one scan; rows that could not be scored carry a note and a null score."""
    return rows.agg(
        F.count("*").alias("seen"),
        F.count("score").alias("scored"),
        F.count_if(F.col("score") > t1).alias("flagged_1"),
        F.count_if((F.col("score") > t5) & (F.col("score") <= t1)).alias("flagged_5"),
        F.count_if(F.col("note") == "too small").alias("too_small"),
        F.count_if(F.col("note") == "error").alias("errors"),
    )


def verdict(score: str, t1: float, t5: float) -> Column:
    s = F.col(score)
    return F.when(s > t1, "flagged").when(s > t5, "suspicious").when(s.isNotNull(), "clear").otherwise("")


def top_suspicious(scores: DataFrame, score: str, item: str, n: int) -> DataFrame:
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col(item)).limit(n)
