"""Reusable pieces of oracle SQL."""


def auc_ctes(src: str, key: str = "detector", grp: str = "grp") -> str:
    """``auc_r(key, grp, n_pos, n_neg, auc)`` from ``src(key, grp, neg 0/1, score)``, by counting below and beside."""
    return f"""
    auc_c AS (SELECT {key}, score, sum(neg) AS eq FROM {src} GROUP BY {key}, score),
    auc_b AS (SELECT {key}, score, eq, sum(eq) OVER (PARTITION BY {key} ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - eq AS below FROM auc_c),
    auc_n AS (SELECT {key}, sum(neg) AS n_neg FROM {src} GROUP BY {key}),
    auc_r AS (SELECT s.{key}, s.{grp}, CAST(count(*) AS BIGINT) AS n_pos, CAST(max(n.n_neg) AS BIGINT) AS n_neg,
                     sum(b.below + b.eq / 2.0::DOUBLE) / (max(n.n_neg) * count(*)) AS auc
              FROM {src} s JOIN auc_b b ON s.{key} = b.{key} AND s.score = b.score JOIN auc_n n ON n.{key} = s.{key}
              WHERE s.neg = 0 GROUP BY s.{key}, s.{grp})"""


def threshold_ctes(src: str, targets: str = "[0.01]") -> str:
    """``thr(detector, target, threshold)`` by cumulative equal-group weight over ``src(detector, grp, score)``."""
    return f"""
    thr_z AS (SELECT detector, grp, count(*) AS n FROM {src} GROUP BY detector, grp),
    thr_g AS (SELECT detector, count(*) AS g FROM thr_z GROUP BY detector),
    thr_w AS (SELECT s.detector, s.score, sum(1.0::DOUBLE / (g.g * z.n)) AS w
              FROM {src} s JOIN thr_z z ON s.detector = z.detector AND s.grp = z.grp
              JOIN thr_g g ON g.detector = s.detector GROUP BY s.detector, s.score),
    thr_a AS (SELECT detector, score, w, sum(w) OVER (PARTITION BY detector ORDER BY score DESC
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS above FROM thr_w),
    thr_f AS (SELECT unnest({targets})::DOUBLE AS target),
    thr AS (SELECT detector, target, min(score) AS threshold FROM thr_a, thr_f
            WHERE above <= target + 1e-12 GROUP BY detector, target)"""


def tpr_ctes(src: str, targets: str = "[0.01, 0.05]") -> str:
    """``tpr_r(detector, grp, target, tpr)``: full ROC vertices per group, then linear interpolation."""
    return f"""
    roc_s AS (SELECT detector, score, sum(neg) AS neg FROM {src} GROUP BY detector, score),
    roc_g AS (SELECT detector, grp, count(*) AS n_pos FROM {src} WHERE neg = 0 GROUP BY detector, grp),
    roc_p AS (SELECT detector, grp, score, count(*) AS pos FROM {src} WHERE neg = 0 GROUP BY detector, grp, score),
    roc_n AS (SELECT detector, sum(neg) AS n_neg FROM {src} GROUP BY detector),
    roc_v AS (SELECT s.detector, g.grp, s.score,
                sum(s.neg) OVER w / n.n_neg::DOUBLE AS fpr, sum(coalesce(p.pos, 0)) OVER w / g.n_pos::DOUBLE AS tpr
              FROM roc_s s JOIN roc_g g ON s.detector = g.detector JOIN roc_n n ON n.detector = s.detector
              LEFT JOIN roc_p p ON p.detector = s.detector AND p.grp = g.grp AND p.score = s.score
              WINDOW w AS (PARTITION BY s.detector, g.grp ORDER BY s.score DESC
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    roc_f AS (SELECT unnest({targets})::DOUBLE AS target),
    roc_q AS (SELECT detector, grp, target,
                coalesce(max(fpr) FILTER (fpr <= target), 0) AS f0, coalesce(max(tpr) FILTER (fpr <= target), 0) AS t0,
                min(fpr) FILTER (fpr > target) AS f1 FROM roc_v, roc_f GROUP BY detector, grp, target),
    roc_t AS (SELECT q.detector, q.grp, q.target, q.f0, q.t0, q.f1, min(v.tpr) AS t1
              FROM roc_q q JOIN roc_v v ON v.detector = q.detector AND v.grp = q.grp AND v.fpr = q.f1
              GROUP BY ALL),
    tpr_r AS (SELECT detector, grp, target, t0 + (target - f0) / (f1 - f0) * (t1 - t0) AS tpr FROM roc_t)"""


SPLIT = """
    neg AS (SELECT detector, grp, score FROM detectors WHERE kind = 'm_val'),
    mt AS (SELECT detector, grp, kind, CASE WHEN kind = 'm_test' THEN 1 ELSE 0 END AS neg, score
           FROM detectors WHERE kind <> 'm_val')"""


def crc32_sql(key: str) -> str:
    """CRC-32 of an ASCII string expression, bit by bit."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({key}) + 1), "
        f"lambda i: ascii(substr({key}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), "
        "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) "
        "ELSE a >> 1 END)), 4294967295::BIGINT)"
    )


def split_sql(key: str, modulus: int, test: str, val: str) -> str:
    """CASE over the bucket ``b`` of the key."""
    b = f"({crc32_sql(key)} % {modulus})"
    return f"CASE WHEN {b} {test} THEN 'test' WHEN {b} {val} THEN 'val' ELSE 'train' END"


def hash60_sql(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws(':', {joined})), 1, 15))::BIGINT"


def uniform_sql(*parts: str) -> str:
    return f"({hash60_sql(*parts)} / 1152921504606846976.0::DOUBLE)"
