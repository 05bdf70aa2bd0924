"""Thresholds and detector metrics over the score views."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.operators import metrics as M
from provspark.operators import ranks as R
from provspark.operators import reports as P
from provspark.operators import thresholds as T
from provspark.plans.fixtures import table, view
from provspark.plans.oracle import SPLIT, auc_ctes, threshold_ctes, tpr_ctes
from provspark.plans.registry import query
from provspark.operators.histogram import score_histogram
from provspark.session import settle

MACHINE = "kind in ('k_gen', 'k_kanal')"


def r6(column, name=None):
    name = name or column
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def big(column, name=None):
    return F.col(column).cast("bigint").alias(name or column)


def parts(spark, sf):
    """All rows, validation, test and machine rows, from one histogram of the scores."""
    d = score_histogram(view(spark, sf, "detectors"))
    return d, d.where("kind = 'm_val'"), d.where("kind = 'm_test'"), d.where(MACHINE)


def row_parts(spark, sf):
    """The same as rows, for reports that need items or sketches."""
    d = view(spark, sf, "detectors")
    return d, d.where("kind = 'm_val'"), d.where("kind = 'm_test'"), d.where(MACHINE)


# --- thresholds -----------------------------------------------------------------------------------------------------


@query(
    "a05_threshold_quantile",
    f"""
    WITH {SPLIT}, f AS (SELECT unnest([0.01, 0.05])::DOUBLE AS target)
    SELECT detector, target, round(CASE WHEN target = 0.01 THEN quantile_cont(score, 0.99)
                                        ELSE quantile_cont(score, 0.95) END, 6) AS threshold
    FROM neg, f GROUP BY detector, target
    """,
)
def a05(spark, sf):
    _, val, _, _ = row_parts(spark, sf)
    return T.threshold_quantile(val, [0.01, 0.05]).select("detector", "target", r6("threshold"))


@query(
    "a06_threshold_group_mean",
    f"""
    WITH {SPLIT}, {threshold_ctes('neg', '[0.01, 0.05, 0.001]')}
    SELECT detector, target, round(threshold, 6) AS threshold FROM thr
    """,
)
def a06(spark, sf):
    _, val, _, _ = row_parts(spark, sf)
    return T.threshold_group_mean(val, [0.01, 0.05, 0.001]).select("detector", "target", r6("threshold"))


@query(
    "a07_threshold_kth",
    f"""
    WITH {SPLIT}, o AS (SELECT detector, score, row_number() OVER (PARTITION BY detector ORDER BY score DESC) AS rn,
                               count(*) OVER (PARTITION BY detector) AS n FROM neg),
    k AS (SELECT detector, max(n) AS n, greatest(1, round_even(0.0025::DOUBLE * max(n), 0)::BIGINT) AS k
          FROM o GROUP BY detector),
    t AS (SELECT o.detector, k.n, k.k, o.score AS threshold FROM o JOIN k ON o.detector = k.detector AND o.rn = k.k)
    SELECT t.detector, CAST(t.n AS BIGINT) AS n, t.k, round(t.threshold, 6) AS threshold,
           round(avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_above,
           round(avg(CASE WHEN m.score >= t.threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at
    FROM t JOIN mt m ON m.detector = t.detector WHERE m.neg = 0 GROUP BY t.detector, t.n, t.k, t.threshold
    """,
)
def a07(spark, sf):
    _, val, _, machine = row_parts(spark, sf)
    cut = T.threshold_kth(val, 0.0025)
    hits = machine.join(cut, "detector").groupBy("detector", "n", "k", "threshold").agg(
        F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("hit_above"),
        F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("hit_at"),
    )
    return hits.select("detector", "n", "k", r6("threshold"), r6("hit_above"), r6("hit_at"))


@query(
    "w13_cumulative_weight",
    f"""WITH {SPLIT}, {threshold_ctes('neg')}
    SELECT detector, round(score, 6) AS score, round(w, 9) AS w, round(above, 9) AS above FROM thr_a""",
)
def w13(spark, sf):
    _, val, _, _ = parts(spark, sf)
    out = T.cumulative_weight(val)
    return out.select("detector", r6("score"), F.round("w", 9).alias("w"), F.round("above", 9).alias("above"))


# --- rates and macro means ------------------------------------------------------------------------------------------


def rates(spark, sf, split=None):
    d, val, _, _ = split or parts(spark, sf)
    thr = T.threshold_group_mean(val, [0.01])
    return settle(M.exceed_rate(d.where("kind <> 'm_val'"), thr, ["detector", "kind", "grp"]))


RATES = f"""{SPLIT}, {threshold_ctes('neg')},
    rates AS (SELECT m.detector, m.kind, m.grp, avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END) AS rate,
                     count(*) AS n
              FROM mt m JOIN thr t ON m.detector = t.detector GROUP BY m.detector, m.kind, m.grp)"""


@query(
    "a03_exceed_rate",
    f"WITH {RATES} SELECT detector, kind, grp, round(rate, 6) AS rate, CAST(n AS BIGINT) AS n FROM rates",
)
def a03(spark, sf):
    return rates(spark, sf).select("detector", "kind", "grp", r6("rate"), "n")


@query(
    "a04_macro_mean",
    f"""WITH {RATES}
    SELECT detector, CASE kind WHEN 'k_gen' THEN 'mixed generators' ELSE 'mixed channels' END AS grp,
           round(avg(rate), 6) AS rate, CAST(count(*) AS BIGINT) AS n_groups
    FROM rates WHERE kind <> 'm_test' GROUP BY detector, kind
    UNION ALL SELECT detector, 'mixed all', round(avg(rate), 6), CAST(count(*) AS BIGINT) FROM rates
    WHERE kind <> 'm_test' GROUP BY detector
    UNION ALL SELECT detector, 'mixed fpr', round(avg(rate), 6), CAST(count(*) AS BIGINT) FROM rates
    WHERE kind = 'm_test' GROUP BY detector""",
)
def a04(spark, sf):
    per_group = rates(spark, sf)
    machine = M.macro_mean(per_group, "rate", ["k_gen", "k_kanal"])
    human = M.macro_mean(per_group, "rate", ["m_test"]).where("grp = 'mixed all'").distinct()
    both = machine.unionByName(human.withColumn("grp", F.lit("mixed fpr")))
    return both.select("detector", "grp", r6("rate"), "n_groups")


@query(
    "a08_auc",
    f"WITH {SPLIT}, {auc_ctes('mt')} SELECT detector, grp, n_pos, n_neg, round(auc, 6) AS auc FROM auc_r",
)
def a08(spark, sf):
    _, _, test, machine = parts(spark, sf)
    return M.auc_by_group(test, machine).select("detector", "grp", "n_pos", "n_neg", r6("auc"))


@query(
    "a09_tpr_at_fpr",
    f"WITH {SPLIT}, {tpr_ctes('mt')} SELECT detector, grp, target, round(tpr, 6) AS tpr FROM tpr_r",
)
def a09(spark, sf):
    _, _, test, machine = parts(spark, sf)
    return M.tpr_at_fpr(test, machine, [0.01, 0.05]).select("detector", "grp", "target", r6("tpr"))


@query(
    "a10_group_metrics",
    f"""WITH {SPLIT}, {threshold_ctes('neg')}, {auc_ctes('mt')}, {tpr_ctes('mt')},
    h AS (SELECT m.detector, m.grp, count(*) AS n, avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END) AS hit
          FROM mt m JOIN thr t ON m.detector = t.detector WHERE m.neg = 0 GROUP BY m.detector, m.grp)
    SELECT h.detector, h.grp, CAST(h.n AS BIGINT) AS n, round(a.auc, 6) AS auc, round(x.tpr, 6) AS tpr_1,
           round(y.tpr, 6) AS tpr_5, round(h.hit, 6) AS hit
    FROM h JOIN auc_r a ON a.detector = h.detector AND a.grp = h.grp
    JOIN tpr_r x ON x.detector = h.detector AND x.grp = h.grp AND x.target = 0.01
    JOIN tpr_r y ON y.detector = h.detector AND y.grp = h.grp AND y.target = 0.05 WHERE h.n >= 40""",
)
def a10(spark, sf):
    _, val, test, machine = parts(spark, sf)
    out = P.group_metrics(test, machine, T.threshold_group_mean(val, [0.01]), min_n=40)
    return out.select("detector", "grp", "n", r6("auc"), r6("tpr_1"), r6("tpr_5"), r6("hit"))


@query(
    "w12_rank_ties_avg",
    """WITH r AS (SELECT detector, score, rank() OVER (PARTITION BY detector ORDER BY score)
                         + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0::DOUBLE AS avg_rank FROM detectors)
    SELECT DISTINCT detector, round(score, 6) AS score, avg_rank FROM r""",
)
def w12(spark, sf):
    out = R.average_ranks(view(spark, sf, "detectors"), ["detector"], "score")
    return out.select("detector", r6("score"), "avg_rank")


@query(
    "a38_rank_mean_fusion",
    f"""WITH {SPLIT}, k AS (SELECT detector, item_id, grp, kind, rank() OVER (PARTITION BY detector ORDER BY score)
                         + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0::DOUBLE AS r,
                         count(*) OVER (PARTITION BY detector) AS n FROM detectors),
    fused AS (SELECT item_id, 'fusion' AS detector, any_value(grp) AS grp, any_value(kind) AS kind,
                     round(sum(r / n), 9) AS score FROM k GROUP BY item_id),
    src AS (SELECT detector, grp, CASE WHEN kind = 'm_test' THEN 1 ELSE 0 END AS neg, score FROM fused
            WHERE kind <> 'm_val'), {auc_ctes('src')}
    SELECT detector, grp, n_pos, n_neg, round(auc, 6) AS auc FROM auc_r""",
)
def a38(spark, sf):
    d = view(spark, sf, "detectors")
    fused = M.rank_fusion(d).select("item_id", F.lit("fusion").alias("detector"), F.round("fused", 9).alias("score"))
    known = view(spark, sf, "scores").select("item_id", "grp", "kind")
    both = fused.join(known, "item_id")
    out = M.auc_by_group(both.where("kind = 'm_test'"), both.where(MACHINE))
    return out.select("detector", "grp", "n_pos", "n_neg", r6("auc"))


@query(
    "j16_variant_grid",
    f"""WITH {SPLIT}, v AS (SELECT DISTINCT detector FROM detectors),
    src AS (SELECT m.detector AS nv, 'x' AS grp, 1 AS neg, m.score FROM mt m WHERE neg = 1
            UNION ALL SELECT v.detector, m.detector, 0, m.score FROM mt m, v WHERE neg = 0), {auc_ctes('src', 'nv')}
    SELECT nv AS neg_variant, grp AS pos_variant, n_pos, n_neg, round(auc, 6) AS auc FROM auc_r""",
)
def j16(spark, sf):
    _, _, test, machine = parts(spark, sf)
    out = P.variant_grid(test, machine, "detector", ["d1", "d2", "d3"])
    return out.select("neg_variant", "pos_variant", "n_pos", "n_neg", r6("auc"))


@query(
    "j17_apply_thresholds",
    """SELECT detector, kind, grp, t.t AS threshold, round(avg(CASE WHEN score > t.t THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate
    FROM detectors, (SELECT unnest([0.5, 1.0, 2.5, 7.5, 12.0])::DOUBLE AS t) t GROUP BY detector, kind, grp, t.t""",
)
def j17(spark, sf):
    out = P.apply_thresholds(view(spark, sf, "detectors"), [0.5, 1.0, 2.5, 7.5, 12.0], ["detector", "kind", "grp"])
    return out.select("detector", "kind", "grp", "threshold", r6("rate"))


# --- whole reports --------------------------------------------------------------------------------------------------


@query(
    "a42_fpr_curve",
    f"""WITH {SPLIT}, {threshold_ctes('neg', '[0.01, 0.005, 0.0025, 0.001]')},
    s1 AS (SELECT detector, threshold AS stored FROM thr WHERE target = 0.01),
    r AS (SELECT m.detector, t.target, t.threshold, m.kind, m.grp,
                 avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END) AS rate
          FROM mt m JOIN thr t ON m.detector = t.detector GROUP BY ALL)
    SELECT r.detector, r.target, round(max(r.threshold), 6) AS threshold,
           round(avg(CASE WHEN kind = 'm_test' THEN rate END), 6) AS fpr,
           round(avg(CASE WHEN kind = 'k_kanal' THEN rate END), 6) AS channel_hit,
           round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(max(r.threshold) - max(s1.stored)))), 6) AS distance
    FROM r JOIN s1 ON s1.detector = r.detector GROUP BY r.detector, r.target""",
)
def a42(spark, sf):
    d, val, _, _ = parts(spark, sf)
    out = P.fpr_curve(val, d.where("kind <> 'm_val'"), [0.01, 0.005, 0.0025, 0.001], stored=0.01)
    return out.select("detector", "target", r6("threshold"), r6("fpr"), r6("channel_hit"), r6("distance"))


BENCH = f"""{RATES}, {auc_ctes('mt')},
    cells AS (SELECT r.detector, r.kind, r.grp, r.rate, a.auc FROM rates r
              LEFT JOIN auc_r a ON a.detector = r.detector AND a.grp = r.grp AND r.kind <> 'm_test')"""


@query(
    "m10_benchmark",
    f"""WITH raw AS (SELECT detector, kind, grp, CASE WHEN detector = 'd1' THEN score / 40.0::DOUBLE ELSE score END AS p
                     FROM detectors),
    span AS (SELECT detector, min(p) >= 0 AND max(p) <= 1 AS prob FROM raw GROUP BY detector),
    z AS (SELECT r.detector, r.kind, r.grp, CASE WHEN s.prob
             THEN ln(greatest(1e-7, least(1 - 1e-7, r.p)) / greatest(1e-7, least(1, 1 - r.p))) ELSE r.p END AS score
          FROM raw r JOIN span s ON s.detector = r.detector),
    neg AS (SELECT detector, grp, score FROM z WHERE kind = 'm_val'),
    mt AS (SELECT detector, grp, kind, CASE WHEN kind = 'm_test' THEN 1 ELSE 0 END AS neg, score FROM z
           WHERE kind <> 'm_val'), {threshold_ctes('neg')},
    rates AS (SELECT m.detector, m.kind, m.grp, avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END) AS rate
              FROM mt m JOIN thr t ON m.detector = t.detector GROUP BY m.detector, m.kind, m.grp), {auc_ctes('mt')},
    cells AS (SELECT r.detector, r.kind, r.grp, r.rate, a.auc FROM rates r
              LEFT JOIN auc_r a ON a.detector = r.detector AND a.grp = r.grp AND r.kind <> 'm_test'),
    long AS (SELECT detector, grp, CASE WHEN kind = 'm_test' THEN 'fpr' ELSE 'hit' END AS metric, rate AS value FROM cells
             UNION ALL SELECT detector, grp, 'auc', auc FROM cells WHERE kind <> 'm_test'
             UNION ALL SELECT detector, CASE kind WHEN 'k_gen' THEN 'mixed generators' WHEN 'k_kanal' THEN 'mixed channels'
                                        ELSE 'mixed' END, CASE WHEN kind = 'm_test' THEN 'fpr' ELSE 'hit' END, avg(rate)
             FROM cells GROUP BY detector, kind
             UNION ALL SELECT detector, CASE kind WHEN 'k_gen' THEN 'mixed generators' ELSE 'mixed channels' END, 'auc',
                              avg(auc) FROM cells WHERE kind <> 'm_test' GROUP BY detector, kind
             UNION ALL SELECT detector, 'mixed all', 'hit', avg(rate) FROM cells WHERE kind <> 'm_test' GROUP BY detector
             UNION ALL SELECT detector, 'mixed all', 'auc', avg(auc) FROM cells WHERE kind <> 'm_test' GROUP BY detector)
    SELECT detector, grp, metric, round(value, 6) AS value FROM long""",
)
def m10(spark, sf):
    raw = view(spark, sf, "detectors").withColumn(
        "score", F.when(F.col("detector") == "d1", F.col("score") / 40.0).otherwise(F.col("score"))
    )
    return P.benchmark(raw, 0.01).select("detector", "grp", "metric", r6("value"))


@query(
    "m14_equal_fpr_compare",
    f"""WITH {SPLIT}, ref AS (SELECT detector, grp, score FROM mt WHERE neg = 1), {threshold_ctes('ref')}, {auc_ctes('mt')},
    h AS (SELECT m.detector, m.grp, count(*) AS n, max(t.threshold) AS threshold,
                 avg(CASE WHEN m.score > t.threshold THEN 1.0::DOUBLE ELSE 0 END) AS hit
          FROM mt m JOIN thr t ON m.detector = t.detector WHERE neg = 0 GROUP BY m.detector, m.grp)
    SELECT h.detector, h.grp, round(h.threshold, 6) AS threshold, CAST(h.n AS BIGINT) AS n, round(h.hit, 6) AS hit,
           round(a.auc, 6) AS auc,
           round(avg(h.hit) OVER (PARTITION BY h.detector), 6) AS mean_hit
    FROM h JOIN auc_r a ON a.detector = h.detector AND a.grp = h.grp""",
)
def m14(spark, sf):
    _, _, test, machine = parts(spark, sf)
    out = P.equal_fpr_compare(test, machine, 0.01)
    return out.select("detector", "grp", r6("threshold"), "n", r6("hit"), r6("auc"), r6("mean_hit"))


@query(
    "m13_robustness_matrix",
    f"""WITH {SPLIT}, base AS (SELECT detector, grp, score FROM neg WHERE detector = 'd1'), {threshold_ctes('base')},
    c AS (SELECT m.detector AS condition, m.grp, m.neg, m.score, t.threshold FROM mt m, thr t),
    src AS (SELECT condition, 'all' AS grp, neg, score FROM c), {auc_ctes('src', 'condition')}
    SELECT c.condition, CAST(sum(1 - c.neg) AS BIGINT) AS n_pos, CAST(sum(c.neg) AS BIGINT) AS n_neg,
           round(avg(CASE WHEN c.neg = 0 THEN CASE WHEN score > threshold THEN 1.0::DOUBLE ELSE 0 END END), 6) AS hit,
           round(avg(CASE WHEN c.neg = 1 THEN CASE WHEN score > threshold THEN 1.0::DOUBLE ELSE 0 END END), 6) AS fpr,
           round(max(a.auc), 6) AS auc, max(f.fpr_groups) AS fpr_groups
    FROM c JOIN auc_r a ON a.condition = c.condition JOIN (SELECT condition, string_agg(concat(grp, '=', CAST(k AS VARCHAR)), ',' ORDER BY grp)
      AS fpr_groups FROM (SELECT condition, grp, CAST(floor(avg(CASE WHEN score > threshold THEN 1.0::DOUBLE ELSE 0 END) * 1000000 + 0.5) AS BIGINT) AS k
      FROM c WHERE neg = 1 GROUP BY condition, grp) GROUP BY condition) f ON f.condition = c.condition GROUP BY c.condition""",
)
def m13(spark, sf):
    d, val, _, _ = row_parts(spark, sf)
    fixed = T.threshold_group_mean(val.where("detector = 'd1'"), [0.01]).select("threshold")
    rows = d.where("kind <> 'm_val'").select(
        F.col("detector").alias("condition"), "grp", (F.col("kind") != "m_test").cast("int").alias("label"), "score"
    )
    out = P.robustness_matrix(rows, fixed)
    groups = F.transform("fpr_groups", lambda g: F.concat(g["grp"], F.lit("="), F.floor(g["fpr"] * 1e6 + 0.5).cast("string")))
    return out.select("condition", "n_pos", "n_neg", r6("hit"), r6("fpr"), r6("auc"), F.array_join(groups, ",").alias("fpr_groups"))


@query(
    "m17_calibrate",
    f"""WITH {SPLIT}, {threshold_ctes('neg', '[0.01, 0.05]')},
    heads AS (SELECT DISTINCT detector AS tag, 3.0::DOUBLE AS thr_1, CASE WHEN detector = 'd1' THEN 2.5::DOUBLE END AS prev
              FROM detectors)
    SELECT h.tag, round(max(CASE WHEN target = 0.01 THEN threshold END), 6) AS thr_1,
           round(max(CASE WHEN target = 0.05 THEN threshold END), 6) AS thr_5,
           round(max(coalesce(h.prev, h.thr_1)), 6) AS thr_1_prev
    FROM heads h JOIN thr ON thr.detector = h.tag GROUP BY h.tag""",
)
def m17(spark, sf):
    d, val, _, _ = parts(spark, sf)
    heads = d.select(F.col("detector").alias("tag")).distinct().select(
        "tag", F.lit(3.0).alias("thr_1"), F.lit(1.0).alias("thr_5"),
        F.when(F.col("tag") == "d1", F.lit(2.5)).alias("thr_1_prev"), F.lit(None).cast("double").alias("thr_5_prev"),
    )
    return P.calibrate(heads, val).select("tag", r6("thr_1"), r6("thr_5"), r6("thr_1_prev"))


@query(
    "m09_vote",
    """WITH p AS (SELECT item_id, max(CASE WHEN detector = 'd1' THEN score END) AS s1,
                         max(CASE WHEN detector = 'd2' THEN score END) AS s2,
                         max(CASE WHEN detector = 'd3' THEN score END) AS s3 FROM detectors GROUP BY item_id),
    v AS (SELECT item_id, CASE WHEN s1 > 8 THEN 1 ELSE 0 END + CASE WHEN s2 > 8 THEN 1 ELSE 0 END AS votes,
                 s3 < 0.5 AS veto FROM p)
    SELECT item_id, CASE WHEN votes < 1 THEN 'none' WHEN veto THEN 'vetoed' WHEN votes >= 2 THEN 'high' ELSE 'review' END
           AS decision FROM v""",
)
def m09(spark, sf):
    return P.vote(
        view(spark, sf, "detectors"), {"d1": 8.0, "d2": 8.0}, candidate=1, majority=2, veto={"d3": 0.5}
    ).select("item_id", "decision")


@query(
    "a28_best_by",
    f"""WITH {SPLIT}, {auc_ctes('mt')}, m AS (SELECT detector, avg(auc) AS a FROM auc_r GROUP BY detector),
    g AS (SELECT grp, max(auc) AS a FROM auc_r GROUP BY grp)
    SELECT 'overall' AS scope, '*' AS grp, detector, round(a, 6) AS auc FROM m WHERE a = (SELECT max(a) FROM m)
    UNION ALL SELECT 'group', r.grp, min(r.detector), round(g.a, 6) FROM auc_r r JOIN g ON g.grp = r.grp AND g.a = r.auc
    GROUP BY r.grp, g.a""",
)
def a28(spark, sf):
    _, _, test, machine = parts(spark, sf)
    return P.best_by(settle(M.auc_by_group(test, machine)), "auc").select("scope", "grp", "detector", r6("auc"))


@query(
    "a36_seed_spread",
    f"""WITH {SPLIT}, {auc_ctes('mt')}
    SELECT grp, CAST(count(*) AS BIGINT) AS n_heads, round(min(auc), 6) AS lo, round(max(auc), 6) AS hi,
           round(stddev_pop(auc), 6) AS std FROM auc_r GROUP BY grp""",
)
def a36(spark, sf):
    _, _, test, machine = parts(spark, sf)
    out = P.seed_spread(M.auc_by_group(test, machine), ["grp"], "auc")
    return out.select("grp", "n_heads", r6("lo"), r6("hi"), r6("std"))


J08 = f"""{BENCH},
    j AS (SELECT b.grp, b.kind, b.rate AS before, e.rate AS after, b.auc AS auc_before, e.auc AS auc_after, o.rate AS other
          FROM cells b JOIN cells e ON e.grp = b.grp AND e.kind = b.kind AND e.detector = 'd2'
          JOIN cells o ON o.grp = b.grp AND o.kind = b.kind AND o.detector = 'd3' WHERE b.detector = 'd1')"""


@query(
    "j08_compare_runs",
    f"""WITH {J08}
    SELECT grp, kind, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM j""",
)
def j08(spark, sf):
    cells = rates(spark, sf)
    out = P.compare_runs(cells.where("detector = 'd1'"), cells.where("detector = 'd2'"), "rate")
    return out.select("grp", "kind", r6("before"), r6("after"), r6("delta"))


@query(
    "a39_exclusion_summary",
    f"""WITH {J08}, x AS (SELECT DISTINCT grp AS experiment FROM j WHERE kind <> 'm_test')
    SELECT x.experiment, round(avg(CASE WHEN j.grp = x.experiment AND kind <> 'm_test' THEN before END), 6) AS hit_before,
           round(avg(CASE WHEN j.grp = x.experiment AND kind <> 'm_test' THEN after END), 6) AS hit_after,
           round(avg(CASE WHEN j.grp = x.experiment AND kind <> 'm_test' THEN auc_before END), 6) AS auc_before,
           round(avg(CASE WHEN j.grp = x.experiment AND kind <> 'm_test' THEN auc_after END), 6) AS auc_after,
           round(avg(CASE WHEN j.grp = x.experiment AND kind <> 'm_test' THEN other END), 6) AS hit_other,
           coalesce(round(avg(CASE WHEN j.grp <> x.experiment AND kind = 'k_gen' THEN after - before END), 6), 0)
             AS delta_generators,
           coalesce(round(avg(CASE WHEN j.grp <> x.experiment AND kind = 'k_kanal' THEN after - before END), 6), 0)
             AS delta_channels,
           round(avg(CASE WHEN kind = 'm_test' THEN after END), 6) AS fpr
    FROM j, x GROUP BY x.experiment""",
)
def a39(spark, sf):
    split = parts(spark, sf)
    auc = M.auc_by_group(split[2], split[3]).select("detector", "grp", "auc")
    cells = settle(rates(spark, sf, split).join(auc, ["detector", "grp"], "left"))
    experiments = cells.where("kind <> 'm_test'").select(F.col("grp").alias("experiment"), "grp").distinct()
    out = P.exclusion_summary(
        cells.where("detector = 'd1'"), cells.where("detector = 'd2'"), cells.where("detector = 'd3'"), experiments
    )
    names = ["hit_before", "hit_after", "auc_before", "auc_after", "hit_other"]
    deltas = ["delta_generators", "delta_channels"]
    return out.select(
        "experiment", *[r6(c) for c in names], *[F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c) for c in deltas], r6("fpr")
    )


@query(
    "j13_complete_coverage",
    """WITH need AS (SELECT DISTINCT event_type FROM events),
    have AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events WHERE value > 60 GROUP BY user_id)
    SELECT user_id FROM have WHERE k = (SELECT count(*) FROM need)""",
)
def j13(spark, sf):
    events = table(spark, sf, "events")
    return P.complete_coverage(
        events.where("value > 60").select("user_id", "event_type"), events.select("event_type"), "user_id", "event_type"
    )


@query(
    "j15_merge_results",
    f"""WITH {RATES}, o AS (SELECT grp, kind, rate FROM rates WHERE detector = 'd1'),
    n AS (SELECT grp, kind, rate FROM rates WHERE detector = 'd2' AND kind <> 'm_test')
    SELECT coalesce(n.grp, o.grp) AS grp, coalesce(n.kind, o.kind) AS kind, round(coalesce(n.rate, o.rate), 6) AS rate
    FROM n FULL JOIN o ON n.grp = o.grp AND n.kind = o.kind""",
)
def j15(spark, sf):
    cells = rates(spark, sf)
    new = cells.where("detector = 'd2' and kind <> 'm_test'").select("grp", "kind", "rate")
    old = cells.where("detector = 'd1'").select("grp", "kind", "rate")
    return P.merge_results(new, old, ["grp", "kind"]).select("grp", "kind", r6("rate"))


@query("a30_ensemble_mean", "SELECT item_id, round(avg(score), 6) AS score FROM detectors GROUP BY item_id")
def a30(spark, sf):
    return P.ensemble_mean(view(spark, sf, "detectors"), "item_id", "score").select("item_id", r6("score"))


@query(
    "a29_view_aggregate",
    """SELECT user_id AS item_id, round(avg(value), 6) AS mean, round(min(value), 6) AS low,
       round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY user_id""",
)
def a29(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("item_id"), F.col("value").alias("score"))
    return P.view_aggregate(rows, "item_id", "score").select("item_id", r6("mean"), r6("low"), r6("median"))


@query(
    "a26_shift_stats",
    """WITH p AS (SELECT a.kind, b.score - a.score AS d FROM detectors a JOIN detectors b ON a.item_id = b.item_id
                  WHERE a.detector = 'd1' AND b.detector = 'd2')
    SELECT kind, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean,
           round(stddev_pop(d), 6) AS std FROM p GROUP BY kind""",
)
def a26(spark, sf):
    d = view(spark, sf, "detectors")
    pairs = P.paired_shift(d.where("detector = 'd1'"), d.where("detector = 'd2'"), "item_id", ["kind"])
    return P.shift_stats(pairs, ["kind"]).select("kind", "n", r6("median"), r6("mean"), r6("std"))


@query(
    "j09_paired_shift",
    """SELECT a.item_id, a.kind, round(a.score, 6) AS before, round(b.score, 6) AS after, round(b.score - a.score, 6) AS shift
    FROM detectors a JOIN detectors b ON a.item_id = b.item_id WHERE a.detector = 'd1' AND b.detector = 'd2'""",
)
def j09(spark, sf):
    d = view(spark, sf, "detectors")
    pairs = P.paired_shift(d.where("detector = 'd1'"), d.where("detector = 'd2'"), "item_id", ["kind"])
    return pairs.select("item_id", "kind", r6("before"), r6("after"), r6("shift"))


@query(
    "t03_ranked_report",
    f"""WITH {SPLIT}, {auc_ctes('mt')}, m AS (SELECT detector, avg(auc) AS auc FROM auc_r GROUP BY detector)
    SELECT detector, round(auc, 6) AS auc, CAST(row_number() OVER (ORDER BY auc DESC, detector) AS INTEGER) AS place FROM m""",
)
def t03(spark, sf):
    _, _, test, machine = parts(spark, sf)
    means = M.auc_by_group(test, machine).groupBy("detector").agg(F.avg("auc").alias("auc"))
    return P.ranked_report(means, "auc", "detector").select("detector", r6("auc"), "place")


@query(
    "a34_pipeline_rates",
    f"""WITH {SPLIT}, {threshold_ctes('neg', '[0.01, 0.001]')},
    t AS (SELECT detector, max(CASE WHEN target = 0.01 THEN threshold END) AS lo,
                 max(CASE WHEN target = 0.001 THEN threshold END) AS hi FROM thr GROUP BY detector),
    g AS (SELECT DISTINCT event_id AS item_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90)
    SELECT d.detector, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN d.score >= t.lo THEN 1.0::DOUBLE ELSE 0 END), 6) AS raw,
           round(avg(CASE WHEN d.score >= t.lo AND g.item_id IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS gated,
           round(avg(CASE WHEN d.score >= t.lo AND g.item_id IS NULL AND d.score >= t.hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS auto
    FROM detectors d JOIN t ON t.detector = d.detector LEFT JOIN g ON g.item_id = d.item_id
    WHERE d.kind = 'm_test' GROUP BY d.detector""",
)
def a34(spark, sf):
    _, val, test, _ = row_parts(spark, sf)
    thr = T.threshold_group_mean(val, [0.01, 0.001])
    gate = table(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("bigint") >= 90)
    out = P.pipeline_rates(test, gate.select(F.col("event_id").alias("item_id")), thr, review=0.01, auto=0.001)
    return out.select("detector", "n", r6("raw"), r6("gated"), r6("auto"))


@query(
    "a35_combined_throughput",
    """WITH v AS (SELECT event_type, sum(value) / 3600.0::DOUBLE AS speed FROM events GROUP BY event_type)
    SELECT round(1.0::DOUBLE / sum(1.0::DOUBLE / speed), 6) AS combined FROM v""",
)
def a35(spark, sf):
    speeds = table(spark, sf, "events").groupBy("event_type").agg((F.sum("value") / 3600.0).alias("speed"))
    return P.combined_throughput(speeds, "speed").select(r6("combined"))


@query(
    "m19_scan_report",
    """WITH t AS (SELECT CAST(8 AS DOUBLE) AS t1, CAST(5 AS DOUBLE) AS t5)
    SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(CASE WHEN e.value >= 5 THEN 1 END) AS BIGINT) AS scored,
           CAST(count(CASE WHEN e.value >= 5 AND s.score > t1 THEN 1 END) AS BIGINT) AS flagged_1,
           CAST(count(CASE WHEN e.value >= 5 AND s.score > t5 AND s.score <= t1 THEN 1 END) AS BIGINT) AS flagged_5,
           CAST(count(CASE WHEN e.value < 5 AND e.value >= 2 THEN 1 END) AS BIGINT) AS too_small,
           CAST(count(CASE WHEN e.value < 2 THEN 1 END) AS BIGINT) AS errors
    FROM events e JOIN scores s ON s.item_id = e.event_id, t""",
)
def m19(spark, sf):
    rows = view(spark, sf, "scores").join(
        table(spark, sf, "events").select(F.col("event_id").alias("item_id"), "value"), "item_id"
    )
    rows = rows.select(
        F.when(F.col("value") >= 5, F.col("score")).alias("score"),
        F.when(F.col("value") < 2, "error").when(F.col("value") < 5, "too small").otherwise("").alias("note"),
    )
    return P.scan_report(rows, 8.0, 5.0)


@query(
    "p17_verdict",
    """SELECT item_id, CASE WHEN score > 8 THEN 'flagged' WHEN score > 5 THEN 'suspicious' ELSE 'clear' END AS verdict
    FROM scores""",
)
def p17(spark, sf):
    return view(spark, sf, "scores").select("item_id", P.verdict("score", 8.0, 5.0).alias("verdict"))


@query(
    "t01_top_suspicious",
    "SELECT item_id, round(score, 6) AS score FROM scores ORDER BY score DESC NULLS LAST, item_id LIMIT 200",
)
def t01(spark, sf):
    return P.top_suspicious(view(spark, sf, "scores"), "score", "item_id", 200).select("item_id", r6("score"))
