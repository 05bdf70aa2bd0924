"""Scalar arithmetic as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, clip: float) -> Column:
    """ln(p / (1 - p)) with both parts kept away from zero."""
    low = F.lit(clip)
    return F.ln(F.greatest(low, F.least(F.lit(1.0 - clip), p)) / F.greatest(low, F.least(F.lit(1.0), F.lit(1.0) - p)))


def fit_within(w: Column, h: Column, longest: int) -> tuple[Column, Column]:
    """Dimensions shrunk so that the long side is at most ``longest``; half-even rounding, at least one pixel."""
    factor = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h, F.lit(1)))

    def side(x: Column) -> Column:
        return F.greatest(F.lit(1), F.bround(x * factor, 0).cast("int"))

    return side(w), side(h)


def aspect_gap(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a / b))


def side_ratio(w: Column, h: Column) -> Column:
    return F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))


def bytes_per_pixel(size: Column, w: Column, h: Column) -> Column:
    return F.when(w * h > 0, size / (w * h))


#: Terms of the error function's series, and the argument from which it is 1 in double precision.
ERF_TERMS, ERF_ONE = 110, 6.0


def gelu(x: Column) -> Column:
    """x * Phi(x), with erf as its series of positive terms: exact but for rounding.

    erf(z) = 2 / sqrt(pi) * exp(-z^2) * (z + z * 2z^2 / 3 + z * (2z^2)^2 / (3 * 5) + ...)
    """
    z = F.greatest(F.lit(-ERF_ONE), F.least(F.lit(ERF_ONE), x / math.sqrt(2.0)))
    double = F.transform(F.array(z), lambda v: F.struct(v.alias("z"), (2.0 * v * v).alias("q")))[0]
    steps = F.sequence(F.lit(1), F.lit(ERF_TERMS))
    # the terms depend on z alone: it is carried along, so that it is computed once
    start = F.struct(double["z"].alias("t"), double["z"].alias("s"), double["q"].alias("q"))

    def step(a: Column, n: Column) -> Column:
        t = a["t"] * a["q"] / (2 * n + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"), a["q"].alias("q"))

    erf = F.aggregate(steps, start, step, lambda a: a["s"]) * F.exp(-z * z) * (2.0 / math.sqrt(math.pi))
    return 0.5 * x * (1.0 + erf)
