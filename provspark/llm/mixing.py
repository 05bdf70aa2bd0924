"""Soft-membership mixing: document rates whose expected token totals per domain meet target weights."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.session import cut_lineage

#: Features of the classifier and bins of each; the counts it learns have FEATURES x BINS x domains cells.
FEATURES, BINS = 7, 16
#: Share of a domain's target that a last move must gain, its tries, and what holds it back where no rates meet the targets.
FINISH, TRIES, DAMPING = 0.01, 20, 1e-6


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, bins): white-space words of the whole text and the binned shape of the text.

    Shape: shares of capitals, digits, marks and line ends, mean length of a word, share of distinct words, length.
    Null and empty texts have 0 tokens and the lowest bins.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = docs.select(
        F.col(id_col).alias("doc_id"), F.length(t).alias("n"), words.alias("w"),
        *(F.regexp_count(t, F.lit(p)).alias(f"c{i}") for i, p in enumerate(("[A-Z]", "[0-9]", r"[!-/|~#^]", r"\n"))),
    )
    size, distinct = F.size("w"), F.size(F.array_distinct("w"))
    rows = counts.select("doc_id", "n", "c0", "c1", "c2", "c3", size.alias("tokens"), distinct.alias("distinct"))
    n, tokens = F.greatest(F.col("n"), F.lit(1)), F.greatest(F.col("tokens"), F.lit(1))
    logs = [_log_bin(F.col(f"c{i}") / n) for i in range(4)]
    mean = F.least(F.floor(F.col("n") / tokens), F.lit(BINS - 1))
    share = F.least(F.floor(F.col("distinct") / tokens * BINS), F.lit(BINS - 1))
    length = F.least(F.floor(F.log2(F.col("n") + 1)), F.lit(BINS - 1))
    bins = F.array(*(c.cast("int") for c in (*logs, mean, share, length)))
    return rows.select("doc_id", F.col("tokens").cast("long"), bins.alias("bins"))


def _log_bin(share: Column) -> Column:
    """0 for a share below 2 ** -14, one more for every doubling."""
    return F.when(share > 0, F.least(F.greatest(F.floor(F.log2(share)) + BINS - 1, F.lit(0)), F.lit(BINS - 1))).otherwise(0)


def posteriors(rows: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, tokens, p): the domains' probabilities by naive Bayes over the bins, learned from a labelled table.

    ``labels`` has doc_id and domain; rows of other or null domains teach nothing. The counts are taken over every
    labelled row; a bin that no row had counts one half, and without any label all domains are equally likely.
    """
    known = labels.where(F.col("domain").isin(domains)).select("doc_id", "domain")
    cells = (
        rows.join(known, "doc_id").select("domain", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("domain", "feature", "bin").count().collect()
    )
    counts = np.full((len(domains), FEATURES, BINS), 0.5)
    for r in cells:
        counts[domains.index(r["domain"]), r["feature"], r["bin"]] += r["count"]
    prior = counts[:, 0].sum(axis=1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    table = F.array(*(F.lit(float(x)) for x in logs.transpose(1, 2, 0).ravel()))  # feature, bin, domain
    d = len(domains)

    def log_of(k: int) -> Column:
        terms = [F.element_at(table, F.lit(f * BINS * d + k + 1) + F.col("bins")[f] * d) for f in range(FEATURES)]
        return sum(terms, F.lit(float(np.log(prior[k] / prior.sum()))))

    scored = rows.select("doc_id", "tokens", F.array(*(log_of(k) for k in range(d))).alias("s"))
    top = F.array_max("s")
    raised = scored.select("doc_id", "tokens", F.transform("s", lambda x: F.exp(x - top)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.select("doc_id", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def least_budget(rows: DataFrame, weights: list[float], lowest: float) -> tuple[float, float]:
    """(budget, highest rate) from which rates that are linear in ``p`` meet all targets with none below ``lowest``.

    With hard memberships these are the rates that a domain's documents share, and the budget is the least at which every
    target is at least ``lowest`` times the tokens there are. (0, 0) where no such rates exist.
    """
    d, t = len(weights), F.col("tokens").cast("double")
    gram = rows.agg(*(F.sum(t * F.col("p")[i] * F.col("p")[j]) for i in range(d) for j in range(d))).first()
    unit = np.linalg.pinv(np.array([x or 0.0 for x in gram]).reshape(d, d)) @ np.array(weights, float)  # rates of a budget of 1
    if unit.min() <= 0:
        return 0.0, 0.0
    return lowest / float(unit.min()), lowest * float(unit.max() / unit.min())


def fit(
    rows: DataFrame, weights: list[float], budget: float, lowest: float = 0.0, highest: float = 4.0,
    start: float = 1.0, rounds: int = 60, tolerance: float = 1e-4,
) -> tuple[DataFrame, np.ndarray]:
    """``rows`` (doc_id, tokens, p) with a rate per document, and what the domains' totals lie above their targets, as
    shares of the budget: least squares under ``lowest`` <= rate <= ``highest``.

    Minimises the squared gaps between the expected domain totals sum(rate * tokens * p[d]) and ``weights[d] * budget``.
    Gradients are scaled by the documents' tokens, so that long documents don't take the whole change. A round is one
    aggregation of as many sums as there are domains. A document's rate follows from its posteriors and the rounds'
    gradients, so no state per document is kept: ``rows`` must be stored, it is read once a round.

    The step is one for all domains, so small ones may lie far off after ``rounds``. Then a last move is solved for, each
    domain at its own pace; it is taken where it brings the worst domain nearer by at least ``FINISH`` of its target.
    """
    d, target = len(weights), np.array(weights, float) * budget
    if budget <= 0:
        return rows.withColumn("rate", F.lit(float(start))), np.zeros(d)
    t = F.col("tokens").cast("double")
    gram = rows.agg(*(F.sum(t * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(d)))
    h = np.array([x or 0.0 for x in gram.first()]).reshape(d, d) / budget
    step = 1.0 / max(float(np.linalg.eigvalsh(h).max()), 1e-12)
    taken: list[list[float]] = []
    for done in range(rounds + 1):
        r = _rate(taken, start, lowest, highest)
        sums = rows.select(t.alias("t"), "p", r.alias("r")).agg(
            *(F.sum(F.col("t") * F.col("r") * F.col("p")[k]).alias(f"s{k}") for k in range(d))
        ).first()
        gap = (np.array([x or 0.0 for x in sums]) - target) / budget
        if done == rounds:
            break
        move = [float(x) for x in step * gap]
        if np.abs(gap).max() < tolerance or (taken and math.dist(move, [0.0] * d) < tolerance * 1e-2):
            break
        taken.append(move)
    rated = rows.withColumn("rate", _rate(taken, start, lowest, highest))
    if np.abs(gap).max() >= tolerance:
        move, then = _last_move(cut_lineage(rated), target / budget, budget, lowest, highest)
        worst = [float((np.abs(g) / np.maximum(target / budget, tolerance)).max()) for g in (gap, then)]
        if then @ then < gap @ gap and worst[1] < worst[0] - FINISH:
            rated, gap = rows.withColumn("rate", _rate([*taken, move], start, lowest, highest)), then
    return rated, gap


def fit_rates(rows: DataFrame, weights: list[float], budget: float, *args, **options) -> DataFrame:
    """The rows of ``fit``; warns where a domain's total stays more than ``FINISH`` of its target off."""
    rated, gap = fit(rows, weights, budget, *args, **options)
    if (np.abs(gap) > FINISH * np.maximum(weights, FINISH)).any():
        warnings.warn(f"domain totals stay off their targets {list(weights)} by {gap.round(4).tolist()} of the budget", stacklevel=2)
    return rated


def _last_move(rated: DataFrame, target: np.ndarray, budget: float, lowest: float, highest: float) -> tuple[list[float], np.ndarray]:
    """A move from stored rates by which the totals meet ``target`` (shares of ``budget``) as nearly as they can, and the
    gaps behind it: Newton's method on the dual, one aggregation of d * (d + 3) / 2 + 1 sums a try, at most ``TRIES``."""
    d = len(target)
    w = F.col("tokens").cast("double") / budget

    def at(move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        raw = F.col("rate") - sum((F.col("p")[k] * float(x) for k, x in enumerate(move)), F.lit(0.0))
        moved = rated.select("p", w.alias("w"), "rate", raw.alias("raw"))
        r = F.greatest(F.lit(float(lowest)), F.least(F.lit(float(highest)), F.col("raw")))
        free = F.when((F.col("raw") > lowest) & (F.col("raw") < highest), F.col("w")).otherwise(0.0)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        out = moved.select("p", "w", "rate", r.alias("r"), free.alias("free")).agg(
            *(F.sum(F.col("w") * F.col("r") * F.col("p")[k]) for k in range(d)),
            *(F.sum(F.col("free") * F.col("p")[i] * F.col("p")[j]) for i, j in pairs),
            F.sum(F.col("w") * (F.col("r") - F.col("rate")) ** 2),
        ).first()
        x = np.array([v or 0.0 for v in out])
        gram = np.zeros((d, d))
        for (i, j), v in zip(pairs, x[d:-1], strict=True):
            gram[i, j] = gram[j, i] = v
        gap = x[:d] - target
        return gap, gram, float(x[-1] / 2 + move @ gap - DAMPING / 2 * (move @ move))

    move, scale = np.zeros(d), 1.0
    gap, gram, value = at(move)
    for _ in range(TRIES):
        slope = gap - DAMPING * move
        if np.abs(slope).max() < DAMPING:
            break
        ahead = np.linalg.solve(gram + DAMPING * np.eye(d), slope)
        tried = at(move + scale * ahead)
        if tried[2] >= value + 1e-4 * scale * float(slope @ ahead):
            move, scale, (gap, gram, value) = move + scale * ahead, 1.0, tried
        else:
            scale /= 4
    return [float(x) for x in move], gap




def _rate(taken: list[list[float]], start: float, lowest: float, highest: float) -> Column:
    first = F.lit(min(max(start, lowest), highest))
    if not taken:
        return first
    moves = F.array(*(F.array(*(F.lit(x) for x in move)) for move in taken))

    def after(rate: Column, move: Column) -> Column:
        dot = F.aggregate(F.zip_with("p", move, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(float(lowest)), F.least(F.lit(float(highest)), rate - dot))

    return F.aggregate(moves, first, after)


def copies(id_col: Column, rate: Column, salt: str = "mix") -> Column:
    """Whole copies whose mean is the rate: its floor, and one more with the rest's probability, drawn from the id."""
    drawn = F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + drawn).cast("int")


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], scale: float = 1.0, lowest: float = 0.0, highest: float = 4.0,
) -> DataFrame:
    """(doc_id, tokens, p, rate, copies) of every document, for targets of ``scale`` times all tokens.

    Where ``lowest`` leaves a domain more tokens than its target, the targets are raised to ``least_budget``, and
    ``highest`` as far as that asks for.
    ``p`` follows the order of ``weights``. Texts that are null or empty have no tokens, so their rates touch no total;
    repeated rows and null ids get rates of their own. Labels without a domain of ``weights`` are not used. An empty
    table gives an empty one.
    """
    domains = list(weights)
    share = [weights[k] / sum(weights.values()) for k in domains]
    rows = cut_lineage(posteriors(cut_lineage(features(docs)), labels, domains))
    budget = float(rows.agg(F.sum("tokens")).first()[0] or 0) * scale
    if lowest > 0 and budget > 0:
        least, most = least_budget(rows, share, lowest)
        if budget < least:
            budget, highest = least, max(highest, most)
    rated = fit_rates(rows, share, budget, lowest, highest)
    return rated.withColumn("copies", copies(F.col("doc_id"), F.col("rate")))
