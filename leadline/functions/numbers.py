"""Numbers: rounding half up, fixed point, and robust statistics over arrays, all as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes a median absolute deviation comparable to a standard deviation.
MAD_TO_SIGMA = 1.4826

ColumnOrName = Column | str


def c(x: ColumnOrName | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x: ColumnOrName) -> Column:
    """Nearest integer as a long, halves toward positive infinity."""
    return F.floor(c(x) + 0.5).cast("long")


def scaled(x: ColumnOrName, factor: float) -> Column:
    """Fixed point: half_up(x * factor), null for null."""
    return half_up(c(x) * F.lit(float(factor)))


def millimetres(x: ColumnOrName) -> Column:
    return scaled(x, 1000)


def metres(mm: ColumnOrName) -> Column:
    return c(mm) / F.lit(1000.0)


def micro(x: ColumnOrName) -> Column:
    return scaled(x, 1_000_000)


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """What a function makes of a value that is worked out once: within a lambda, Spark works out what is named twice twice."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def sorted_median(xs: Column) -> Column:
    """Median of an ascending array: the mean of the two middle ones for an even count, null for none."""

    def middle(a: Column) -> Column:
        n = F.size(a)
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(a, lo) + F.get(a, hi)) / F.lit(2.0))

    return bound(xs, middle)


def median(xs: ColumnOrName) -> Column:
    return sorted_median(F.array_sort(c(xs)))


def counted_median(counts: Column) -> Column:
    """Median of values given as an array of (x, n), in any order, values more than once too; null for none."""

    def middle(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("long"), lambda t, v: t + v["n"])

        def of(m: Column) -> Column:
            nothing = F.lit(None).cast("double")
            start = F.struct(F.lit(0).cast("long").alias("seen"), nothing.alias("lo"), nothing.alias("hi"))

            def take(s: Column, v: Column) -> Column:
                seen = s["seen"] + v["n"]
                at = lambda got, place: F.when(got.isNull() & (seen > place), v["x"]).otherwise(got)
                return F.struct(seen.alias("seen"), at(s["lo"], F.floor((m - 1) / 2)).alias("lo"), at(s["hi"], F.floor(m / 2)).alias("hi"))

            return F.aggregate(a, start, take, lambda s: (s["lo"] + s["hi"]) / F.lit(2.0))

        return bound(total, of)

    return bound(F.array_sort(counts), middle)


def counted_robust_sigma(counts: Column, centre: Column) -> Column:
    """Scaled MAD about a centre of values given as an array of (x, n); 0 with fewer than two values."""
    away = bound(centre, lambda m: counted_median(F.transform(counts, lambda v: F.struct(F.abs(v["x"] - m).alias("x"), v["n"].alias("n")))))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, v: t + v["n"])
    return F.when(total < 2, F.lit(0.0)).otherwise(F.lit(MAD_TO_SIGMA) * away)


def mad(xs: ColumnOrName, centre: Column | None = None) -> Column:
    """Median absolute deviation about a centre, or about the array's own median."""
    mid = median(xs) if centre is None else centre
    return bound(mid, lambda m: sorted_median(F.array_sort(F.transform(c(xs), lambda x: F.abs(x - m)))))


def robust_sigma(xs: ColumnOrName) -> Column:
    """Scaled MAD; 0 with fewer than two values."""
    return F.when(F.size(c(xs)) < 2, F.lit(0.0)).otherwise(F.lit(MAD_TO_SIGMA) * mad(xs))


def weighted_geometric_mean(parts: list[tuple[Column, float]]) -> Column:
    """exp of the weighted mean logarithm, values held in [0.001, 1]; weights of 0 or less don't count."""
    kept = [(v, float(w)) for v, w in parts if w > 0]
    total = sum(w for _, w in kept)
    if not kept:
        return F.lit(0.0)
    logs = [F.ln(F.least(F.greatest(v, F.lit(0.001)), F.lit(1.0))) * F.lit(w) for v, w in kept]
    out = logs[0]
    for x in logs[1:]:
        out = out + x
    return F.exp(out / F.lit(total))


class Plain:
    """Names of column functions for plain numbers, so that one formula serves both."""

    cos, sin, asin, acos, atan2, sqrt, radians, degrees = math.cos, math.sin, math.asin, math.acos, math.atan2, math.sqrt, math.radians, math.degrees
    abs, least, greatest, lit = abs, min, max, float


def of(m, x: ColumnOrName | float):
    """A column of a name or number, or the number itself where numbers are meant."""
    return x if m is Plain else c(x)


def hypot3(*xs: ColumnOrName | float, m=F):
    """Root of the sum of squares."""
    total = of(m, xs[0]) * of(m, xs[0])
    for x in xs[1:]:
        total = total + of(m, x) * of(m, x)
    return m.sqrt(total)
