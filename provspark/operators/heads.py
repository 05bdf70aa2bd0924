"""Scoring heads: apply stored ones, train logistic ones with Spark ML, and probe what they use."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.hashing import uniform
from provspark.functions.vectors import dot
from provspark.operators.boosting import probe_scores
from provspark.operators.histogram import TIMES, mean_of, rows_of, times
from provspark.operators.metrics import auc_by_group, auc_two_sided, tpr_at_fpr
from provspark.operators.ranks import exact_quantiles
from provspark.functions.numeric import ERF_ONE, ERF_TERMS
from provspark.operators.thresholds import threshold_group_mean
from provspark.session import cut_lineage

# The grid of inverse regularisation strengths.
C_GRID = (0.1, 1.0, 10.0)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def erf(x: np.ndarray) -> np.ndarray:
    """The series of ``functions.numeric.gelu`` for a whole array."""
    z = np.clip(x, -ERF_ONE, ERF_ONE)
    q, term = 2.0 * z * z, z.copy()
    total = z.copy()
    for n in range(1, ERF_TERMS + 1):
        term *= q / (2 * n + 1)
        total += term
        if np.abs(term).max(initial=0.0) < 1e-17:
            break
    return total * np.exp(-z * z) * (2.0 / math.sqrt(math.pi))


def _mlp(x: np.ndarray, head: Mapping) -> np.ndarray:
    z = (x - np.asarray(head["mean"])) / np.asarray(head["scale"])
    h = z @ np.asarray(head["w1"]).T + np.asarray(head["b1"])
    h = 0.5 * h * (1.0 + erf(h / math.sqrt(2.0)))
    return (h @ np.asarray(head["w2"]).T + np.asarray(head["b2"]))[:, 0]


def score_heads(features: DataFrame, heads: Sequence[Mapping], vec: str = "vec", score: str = "score") -> DataFrame:
    """Mean logit over an ensemble, as matrix products over Arrow batches: the plan does not grow with the width.

    The logistic heads of an ensemble are one product with the sum of their scaled weights. Null vectors score null.
    """
    linear = [h for h in heads if h["kind"] == "logistic"]
    nets = [h for h in heads if h["kind"] == "mlp"]
    weight, shift = None, 0.0
    for h in linear:
        scaled = np.asarray(h["coef"], np.float64) / np.asarray(h["scale"], np.float64)
        weight = scaled if weight is None else weight + scaled
        shift += float(h["intercept"]) - float(scaled @ np.asarray(h["mean"], np.float64))
    count = float(len(heads))

    def forward(batch: pd.Series) -> pd.Series:
        out = np.full(len(batch), np.nan)
        known = np.flatnonzero(batch.notna().to_numpy())
        if len(known):
            x = np.stack(batch.iloc[known].to_list()).astype(np.float64)
            total = np.zeros(len(known)) if weight is None else x @ weight + shift
            out[known] = sum((_mlp(x, h) for h in nets), total) / count
        return pd.Series(out).where(batch.notna().to_numpy())

    return features.withColumn(score, F.pandas_udf(forward, "double")(F.col(vec)))


def train_logistic(
    train: DataFrame, val: DataFrame, weight: str = "w", grid: Sequence[float] = C_GRID, max_iter: int = 100
) -> tuple[object, DataFrame]:
    """Weighted logistic head; C chosen by validation AUC. Returns the model and (C, val_auc).

    The penalty is averaged over the weight mass, so regParam = 1 / (C * sum of weights); inputs are standardised by the
    caller, the intercept is free.
    """
    data = train.select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"), weight)
    data = data.persist()
    try:
        mass = data.agg(F.sum(weight)).first()[0]
        best, rows = None, []
        for c in grid:
            fit = LogisticRegression(
                weightCol=weight, regParam=1.0 / (c * mass), elasticNetParam=0.0, standardization=False, maxIter=max_iter
            ).fit(data)
            auc = auc_two_sided(apply_logistic(val, fit), []).first()["auc"]
            rows.append((float(c), float(auc)))
            if best is None or auc > best[0]:
                best = (auc, fit)
    finally:
        data.unpersist()
    return best[1], train.sparkSession.createDataFrame(rows, "C double, val_auc double")


def apply_logistic(df: DataFrame, model) -> DataFrame:
    return df.withColumn(
        "score", dot(F.col("vec"), _numbers(model.coefficients.toArray())) + F.lit(float(model.intercept))
    )


def poisson_weight(seed: int, item: Column) -> Column:
    """Poisson(1) draw per row from its hash: a bootstrap that needs no resampling."""
    u = uniform(seed, item, "bootstrap")
    tail, k, acc = math.exp(-1.0), 1, F.lit(0)
    cumulative = tail
    while k <= 10:
        acc = acc + (u > F.lit(cumulative)).cast("int")
        tail /= k
        cumulative += tail
        k += 1
    return acc.cast("double")


def train_ensemble(train: DataFrame, val: DataFrame, seeds: Sequence[int], item: str = "item_id", c: float = 1.0) -> list:
    """One head per seed on bootstrap weights."""
    models = []
    for seed in seeds:
        weighted = train.withColumn("_wb", F.col("w") * poisson_weight(seed, F.col(item))).where("_wb > 0")
        models.append(train_logistic(weighted, val, "_wb", [c])[0])
    return models


def ensemble_scores(df: DataFrame, models: Sequence) -> DataFrame:
    total = F.lit(0.0)
    for m in models:
        total = total + dot(F.col("vec"), _numbers(m.coefficients.toArray())) + F.lit(float(m.intercept))
    return df.withColumn("score", total / float(len(models)))


def leave_group_out(df: DataFrame, experiments: Mapping[str, Sequence], group: str, c: float = 1.0) -> DataFrame:
    """Per experiment: retrain without some machine groups, test on them against all held-out humans.

    Columns label, split, w, vec and the group. One row per experiment: AUC and TPR at 1 % on the unseen groups.
    """
    out = None
    for name, left_out in experiments.items():
        unseen = F.col(group).isin(*left_out)
        if df.where(unseen).isEmpty():
            raise ValueError(f"experiment {name} leaves nothing out")
        known = df.where(~unseen)
        model, _ = train_logistic(known.where("split = 'train'"), known.where("split = 'val'"), grid=[c])
        test = apply_logistic(df.where("split = 'test'"), model).withColumn("detector", F.lit(name))
        neg, pos = test.where("label = 0"), test.where(unseen & (F.col("label") == 1)).withColumn("grp", F.lit("unseen"))
        rows = auc_by_group(neg, pos).join(tpr_at_fpr(neg, pos, [0.01]), ["detector", "grp"])
        rows = rows.select(F.col("detector").alias("experiment"), "auc", "tpr", "n_neg", "n_pos")
        out = rows if out is None else out.unionByName(rows)
    return out


def stack(scores: DataFrame, head: str, others: Sequence[str], fpr: float = 0.01) -> DataFrame:
    """Does a head gain from other detectors? Each alone, each pair with the head, all together.

    Fit on validation humans and generators with balanced classes, threshold at the quantile of the fit negatives,
    judged on test humans and channels. Columns item_id, kind, detector, score. Items that a detector has no score for
    cannot be compared: ``left_out`` has their number.

    Items of equal scores are counted once and are one row from there on; all combinations are judged together.
    """
    columns = [head, *others]
    wide = scores.groupBy("item_id", "kind").pivot("detector", columns).agg(F.max("score"))
    counted = wide.groupBy("kind", *columns, F.col("item_id").isNull().alias("_nameless")).agg(F.count("*").alias(TIMES))
    counted = cut_lineage(counted.withColumn("label", F.col("kind").startswith("k_").cast("int")))
    known = counted.where("not _nameless").drop("_nameless").na.drop()
    left_out = (counted.agg(rows_of(counted)).first()[0] or 0) - (known.agg(rows_of(known)).first()[0] or 0)
    in_fit, in_test = F.col("kind").isin("m_val", "k_gen"), F.col("kind").isin("m_test", "k_kanal")
    fit = known.where(in_fit)
    n = fit.agg(F.sum((1 - F.col("label")) * times(fit)).alias("n0"), F.sum(F.col("label") * times(fit)).alias("n1")).first()
    mass = n["n0"] + n["n1"]
    balance = F.when(F.col("label") == 0, mass / (2.0 * n["n0"])).otherwise(mass / (2.0 * n["n1"]))
    sets = [[head], *[[o] for o in others], *[[head, o] for o in others], columns]
    judged = []
    for i, chosen in enumerate(sets):
        score = F.col(chosen[0]).cast("double")
        if len(chosen) > 1:
            vec = F.array(*[F.col(c).cast("double") for c in chosen])
            data = fit.select(
                array_to_vector(vec).alias("features"), F.col("label").cast("double").alias("label"), (balance * times(fit)).alias("w")
            )
            model = LogisticRegression(
                weightCol="w", regParam=1.0 / mass, elasticNetParam=0.0, standardization=False
            ).fit(data)
            score = dot(vec, _numbers(model.coefficients.toArray())) + F.lit(float(model.intercept))
        judged.append(F.struct(F.lit(i).alias("place"), F.lit(" + ".join(chosen)).alias("combination"), score.alias("score")))
    keys = ["place", "combination"]
    long = known.select(in_fit.alias("_fit"), in_test.alias("_test"), "label", TIMES, F.explode(F.array(*judged)).alias("j"))
    long = long.select("_fit", "_test", "label", TIMES, "j.*")
    cuts = exact_quantiles(long.where("_fit and label = 0"), keys, "score", [1.0 - fpr]).select(*keys, F.col("q0").alias("_cut"))
    test = long.where("_test").drop("_fit", "_test")
    flagged = (F.col("score") > F.col("_cut")).cast("double")
    rates = test.join(F.broadcast(cuts), keys).groupBy(*keys).agg(
        mean_of(F.when(F.col("label") == 0, flagged), test).alias("fpr"), mean_of(F.when(F.col("label") == 1, flagged), test).alias("hit")
    )
    both = auc_two_sided(test, keys).join(rates, keys)
    return both.select("combination", "auc", "hit", "fpr", F.lit(left_out).cast("bigint").alias("left_out"))


def leak_probe(df: DataFrame, columns: Sequence[str], group: str, trees: int = 300, depth: int = 4) -> DataFrame:
    """Boosted trees on nuisance columns only: total AUC and per machine group; near 0.5 means no leak.

    Columns label, split, the group and the nuisance columns. Unknown values are a value of their own, so every test row
    is judged.
    """
    test = cut_lineage(probe_scores(df, columns, group, trees, depth)).withColumn("detector", F.lit("probe"))
    neg, pos = test.where("label = 0"), test.where("label = 1")
    total = auc_by_group(neg, pos.withColumn("grp", F.lit("all")))
    return total.unionByName(auc_by_group(neg, pos)).select("grp", "auc", "n_neg", "n_pos")


def leak_probes(df: DataFrame, variants: Mapping[str, Sequence[str]], group: str, **how) -> DataFrame:
    """The probe on several sets of nuisance columns, as on raw and on normalised ones, side by side (variant, ...)."""
    out = None
    for name, columns in variants.items():
        part = leak_probe(df, columns, group, **how).select(F.lit(name).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def grouped_cv_probe(df: DataFrame, group: str, folds: int, c: float = 0.1) -> DataFrame:
    """Out-of-fold AUC of a linear probe; members of a group share a fold."""
    fold = F.crc32(F.encode(F.col(group).cast("string"), "utf-8")) % folds
    marked = cut_lineage(df.withColumn("fold", fold).withColumn("w", F.lit(1.0)))
    out = None
    for k in range(folds):
        train, test = marked.where(F.col("fold") != k), marked.where(F.col("fold") == k)
        model, _ = train_logistic(train, test, grid=[c])
        part = apply_logistic(test, model).select("label", "score", "fold")
        out = part if out is None else out.unionByName(part)
    return auc_two_sided(out, [])


def ablation(df: DataFrame, variants: Mapping[str, tuple[int, int]], fpr: float = 0.01, c: float = 1.0) -> DataFrame:
    """The same rows and weights with different feature slices, each judged at the same mean false-positive rate."""
    scored = None
    for name, (start, length) in variants.items():
        cut = df.withColumn("vec", F.slice("vec", start, length))
        model, _ = train_logistic(cut.where("split = 'train'"), cut.where("split = 'val'"), grid=[c])
        part = apply_logistic(cut.where("split <> 'train'"), model).select(
            F.lit(name).alias("detector"), "grp", "split", "label", "score"
        )
        scored = part if scored is None else scored.unionByName(part)
    neg, pos = scored.where("label = 0 and split = 'test'"), scored.where("label = 1 and split = 'test'")
    val_thr = threshold_group_mean(scored.where("label = 0 and split = 'val'"), [fpr]).select(
        "detector", F.col("threshold").alias("val_threshold")
    )
    test_thr = threshold_group_mean(neg, [fpr]).select("detector", F.col("threshold").alias("equal_threshold"))
    hits = pos.join(val_thr, "detector").join(test_thr, "detector").groupBy("detector", "grp").agg(
        F.avg((F.col("score") > F.col("val_threshold")).cast("double")).alias("hit_val"),
        F.avg((F.col("score") > F.col("equal_threshold")).cast("double")).alias("hit_equal"),
    )
    return hits.join(auc_by_group(neg, pos).select("detector", "grp", "auc"), ["detector", "grp"])
