"""Scalar conventions that decide parity: guarded ratios, half-even rounding, islands."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, least: float = 1.0) -> Column:
    """a / max(b, least)."""
    return a / F.greatest(b, F.lit(least))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def hmean(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the intersection of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def by(*keys: str):
    return Window.partitionBy(*keys)


def rounded(c: Column, digits: int) -> Column:
    """Rounded as in SQL, where what is below zero and rounds to it keeps its sign: -0.0."""
    r = F.round(c, digits)
    return F.when((r == 0) & (c < 0), -F.abs(r)).otherwise(r)


def axis(xs: Iterable[float], ys: Iterable[float]) -> float | None:
    """The angle of greatest variance of points in the given order, above -pi/2 and up to it; null
    with under 2 points. Where the exact covariance is 0, its sign hangs on the last bit of the
    sums. So these are running updates point by point with the roundings of DuckDB's var_samp and
    covar_samp(x, y), which adds the product without rounding it first; Spark's aggregates round
    otherwise, and once more where partial ones meet."""
    n = 0
    mx = my = xx = yy = xy = 0.0
    for x, y in zip(xs, ys, strict=True):
        n += 1
        dx, dy = x - mx, y - my
        mx += dx / n
        my += dy / n
        xx += (x - mx) * dx
        yy += (y - my) * dy
        xy = math.fma(dy, x - mx, xy)
    n -= 1
    return math.atan2(2 * (xy / n), xx / n - yy / n) / 2 if n > 0 else None
