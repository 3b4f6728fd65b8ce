"""Numbers and arrays of numbers as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimals(x: Column, n: int) -> Column:
    return F.rint(x * 10**n) / 10**n


def is_even(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 0


def is_odd(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 1


def even(x: Column, greater: bool = False) -> Column:
    """The even number below (or above) x; even ones stay."""
    step = 1 if greater else -1
    return F.when(is_even(x), x).otherwise(x + step)


def power_of_two(x: Column) -> Column:
    """Largest power of two up to x."""
    return F.pow(F.lit(2.0), F.floor(F.log2(x.cast("double"))))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def to_polar(x: Column, y: Column) -> Column:
    return F.struct(F.hypot(x, y).alias("r"), F.atan2(y, x).alias("t"))


def to_cartesian(r: Column, t: Column) -> Column:
    return F.struct((r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"))


def closest_divisor(a: Column, b: Column) -> Column:
    """Divisor of a nearest to b (ties: the smaller)."""
    d = F.filter(F.sequence(F.lit(1), a), lambda k: F.pmod(a, k) == 0)
    return F.aggregate(d, F.element_at(d, 1), lambda best, k: F.when(F.abs(k - b) < F.abs(best - b), k).otherwise(best))


def sequence(start, stop, step=1) -> Column:
    """start, start + step, ... up to stop; empty if that is fewer than two steps."""
    n = round((stop - start) / step)
    return F.array(*[F.lit(float(start + i * step)) for i in range(n + 1)]) if n > 1 else F.array().cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature))
    return F.transform(e, lambda x: x / total(e))


def whiten(a: Column, mu: float, std: float, scale: float = 1.0) -> Column:
    return F.transform(a, lambda x: (x * scale - mu) / std)


def gain(a: Column, g: float) -> Column:
    return F.transform(a, lambda x: x * g)


def unit(a: Column, eps: float = 1e-16) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: x / (n + eps))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def gaussian(m: int, std: float, sym: bool = True) -> list[float]:
    """Window of m weights."""
    n = m if sym else m + 1
    return [math.exp(-0.5 * ((i - (n - 1) / 2) / std) ** 2) for i in range(n)][:m]


def gaussian2d(mux: float, muy: float, sx: float, sy: float, h: int, w: int) -> Column:
    f = lambda x, y: F.lit(math.exp(-0.5 * (((x - mux) / sx) ** 2 + ((y - muy) / sy) ** 2)))
    return F.array(*[F.array(*[f(x, y) for x in range(w)]) for y in range(h)])


def interp1d(xs: list[float], ys: list[float], x: Column) -> Column:
    """Piecewise linear, constant beyond the ends; xs ascending."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(ys[-1])))
