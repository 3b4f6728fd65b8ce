"""Points with a radius, ellipses and plane transforms as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions.box import _d


def point(x, y, r=0.0) -> Column:
    return F.struct(_d(x).alias("x"), _d(y).alias("y"), _d(r).alias("r"))


def dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def within(a: Column, b: Column) -> Column:
    """a's centre lies within b's radius."""
    return dist(a, b) <= b["r"]


def in_box(p: Column, b: Column) -> Column:
    return B.holds_point(b, p["x"], p["y"])


def in_image(p: Column, w, h) -> Column:
    return in_box(p, B.frame(w, h))


def bounding_box(p: Column) -> Column:
    return B.box(p["x"] - p["r"], p["y"] - p["r"], p["x"] + p["r"], p["y"] + p["r"])


def meets(a: Column, b: Column) -> Column:
    return dist(a, b) <= a["r"] + b["r"]


def iou(a: Column, b: Column) -> Column:
    return B.iou(bounding_box(a), bounding_box(b))


def cover(a: Column, b: Column) -> Column:
    return B.cover(bounding_box(a), bounding_box(b))


def mean_of(points: Column) -> Column:
    m = lambda f: F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]), F.size(points).cast("double"))
    return point(m("x"), m("y"), m("r"))


def translate(p: Column, dx=0, dy=0) -> Column:
    return point(p["x"] + _d(dx), p["y"] + _d(dy), p["r"])


def rescale(p: Column, s) -> Column:
    return point(p["x"] * _d(s), p["y"] * _d(s), p["r"] * _d(s))


def scale(p: Column, sx=1, sy=1, sr=1) -> Column:
    return point(p["x"] * _d(sx), p["y"] * _d(sy), p["r"] * _d(sr))


def fliplr(p: Column, w) -> Column:
    return point(_d(w) - p["x"], p["y"], p["r"])


def flipud(p: Column, h) -> Column:
    return point(p["x"], _d(h) - p["y"], p["r"])


def rot90cw(p: Column, h, w) -> Column:
    return point(_d(h) - p["y"], p["x"], p["r"])


def rot90ccw(p: Column, h, w) -> Column:
    return point(p["y"], _d(w) - p["x"], p["r"])


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"], a["r"])


def sub(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["r"])


def ellipse_area(e: Column) -> Column:
    return math.pi * e["major"] * e["minor"]


def ellipse_box(e: Column) -> Column:
    """Box with the ellipse's axes (angle 0)."""
    return B.box(e["x"] - e["major"], e["y"] - e["minor"], e["x"] + e["major"], e["y"] + e["minor"])


def ellipse_holds(e: Column, x, y) -> Column:
    dx, dy = _d(x) - e["x"], _d(y) - e["y"]
    c, s = F.cos(e["phi"]), F.sin(e["phi"])
    return F.pow(F.try_divide(c * dx + s * dy, e["major"]), 2) + F.pow(F.try_divide(s * dx - c * dy, e["minor"]), 2) <= 1


def ellipse_rescale(e: Column, k) -> Column:
    return F.struct(*[(e[f] * _d(k)).alias(f) for f in ("major", "minor", "x", "y")], e["phi"].alias("phi"))


def ellipse_mask(e: Column, w: int, h: int) -> Column:
    """h rows of w flags, true where the cell's corner lies in the ellipse."""
    xs, ys = F.sequence(F.lit(0), F.lit(w - 1)), F.sequence(F.lit(0), F.lit(h - 1))
    return F.transform(ys, lambda y: F.transform(xs, lambda x: ellipse_holds(e, x, y)))


def matmul(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(r, c)) for c in zip(*b)] for r in a]


def similarity(tx: float = 0, ty: float = 0, r: float = 0, s: float = 1) -> list[list[float]]:
    """3x3: rotation by r and scaling by s, then the shift."""
    return [[s * math.cos(r), -s * math.sin(r), tx], [s * math.sin(r), s * math.cos(r), ty], [0, 0, 1]]


def affine(tx: float = 0, ty: float = 0, r: float = 0, sx: float = 1, sy: float = 1, kx: float = 0, ky: float = 0) -> list[list[float]]:
    """3x3: scale, shear, rotation, shift."""
    shear = [[1, kx, 0], [ky, 1, 0], [0, 0, 1]]
    return matmul(similarity(tx, ty, r), matmul(shear, [[sx, 0, 0], [0, sy, 0], [0, 0, 1]]))


def apply_homography(m: Sequence[Sequence[float]], p: Column) -> Column:
    x, y = p["x"], p["y"]
    row = lambda r: m[r][0] * x + m[r][1] * y + m[r][2]
    return point(F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2)), p["r"])


def covariance_ellipse(sxx: Column, sxy: Column, syy: Column, x: Column, y: Column) -> Column:
    """Axes (roots of the eigenvalues) and angle of a 2x2 covariance."""
    half, d = (sxx + syy) / 2, F.sqrt(F.pow((sxx - syy) / 2, 2) + sxy * sxy)
    return F.struct(F.sqrt(half + d).alias("major"), F.sqrt(F.greatest(half - d, F.lit(0.0))).alias("minor"), x.alias("x"), y.alias("y"), (F.atan2(2 * sxy, sxx - syy) / 2).alias("phi"))
