"""Boxes: structs of xmin, ymin, xmax, ymax. Every function maps columns to a column; null in, null out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    c = F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))
    return c.cast("double")


def box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(_d(xmin).alias("xmin"), _d(ymin).alias("ymin"), _d(xmax).alias("xmax"), _d(ymax).alias("ymax"))


def from_xywh(x, y, w, h) -> Column:
    return box(x, y, _d(x) + _d(w), _d(y) + _d(h))


def from_centroid(xc, yc, w, h) -> Column:
    return box(_d(xc) - _d(w) / 2, _d(yc) - _d(h) / 2, _d(xc) + _d(w) / 2, _d(yc) + _d(h) / 2)


def from_strings(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Texts such as '1E2'; any that is no number makes its corner null."""
    return box(*[c.try_cast("double") for c in (xmin, ymin, xmax, ymax)])


def from_mask(mask: Column) -> Column:
    """Smallest box around the non-zero cells of array<array<double>>, in cells; null if there are none."""
    rows = F.transform(mask, lambda r: F.exists(r, lambda v: v != 0))
    width = F.size(F.element_at(mask, 1))
    cols = F.transform(F.sequence(F.lit(1), width), lambda j: F.exists(mask, lambda r: F.element_at(r, j) != 0))
    first = lambda a: F.array_position(a, F.lit(True)) - 1
    last = lambda a: F.size(a) - F.array_position(F.reverse(a), F.lit(True))
    return F.when(F.exists(rows, lambda v: v), box(first(cols), first(rows), last(cols) + 1, last(rows) + 1))


def _p(b: Column):
    return b["xmin"], b["ymin"], b["xmax"], b["ymax"]


def width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def aspect_ratio(b: Column) -> Column:
    return F.try_divide(width(b), height(b))


def xcentroid(b: Column) -> Column:
    return b["xmin"] + width(b) / 2


def ycentroid(b: Column) -> Column:
    return b["ymin"] + height(b) / 2


def min_dim(b: Column) -> Column:
    return F.least(width(b), height(b))


def max_dim(b: Column) -> Column:
    return F.greatest(width(b), height(b))


def corner(b: Column, which: str) -> Column:
    """ul, ur, ll or lr as struct(x, y)."""
    x = b["xmin"] if which[1] == "l" else b["xmax"]
    y = b["ymin"] if which[0] == "u" else b["ymax"]
    return F.struct(x.alias("x"), y.alias("y"))


def valid(b: Column) -> Column:
    """Zero size is valid; NaN is not."""
    nan = reduce(lambda x, y: x | y, [F.isnan(c) for c in _p(b)])
    return ~nan & (width(b) >= 0) & (height(b) >= 0)


def degenerate(b: Column) -> Column:
    return ~valid(b)


def nonnegative(b: Column) -> Column:
    return reduce(lambda x, y: x & y, [c >= 0 for c in _p(b)])


def is_integer(b: Column) -> Column:
    return reduce(lambda x, y: x & y, [c == F.rint(c) for c in _p(b)])


def is_even(b: Column) -> Column:
    return is_integer(b) & reduce(lambda x, y: x & y, [F.pmod(c, F.lit(2.0)) == 0 for c in _p(b)])


def is_square(b: Column) -> Column:
    return width(b) == height(b)


def same(a: Column, b: Column) -> Column:
    """Equal after rounding of xmin, ymin, width, height (half to even)."""
    f = lambda x: [F.rint(c) for c in (x["xmin"], x["ymin"], width(x), height(x))]
    return reduce(lambda x, y: x & y, [p == q for p, q in zip(f(a), f(b))])


def rounded(b: Column) -> Column:
    """Corner and size rounded half to even."""
    return from_xywh(F.rint(b["xmin"]), F.rint(b["ymin"]), F.rint(width(b)), F.rint(height(b)))


def digits(b: Column, n: int) -> Column:
    return box(*[F.bround(c, n) for c in _p(b)])


def even(b: Column) -> Column:
    return box(*[F.floor(c / 2) * 2 for c in _p(rounded(b))])


def translate(b: Column, dx=0, dy=0) -> Column:
    return box(b["xmin"] + _d(dx), b["ymin"] + _d(dy), b["xmax"] + _d(dx), b["ymax"] + _d(dy))


def to_origin(b: Column) -> Column:
    return translate(b, -b["xmin"], -b["ymin"])


def set_origin(b: Column, other: Column) -> Column:
    return translate(b, -other["xmin"], -other["ymin"])


def grow(b: Column, left=0, top=0, right=0, bottom=0) -> Column:
    return box(b["xmin"] - _d(left), b["ymin"] - _d(top), b["xmax"] + _d(right), b["ymax"] + _d(bottom))


def resized(b: Column, w, h) -> Column:
    """Width and height about the centre."""
    return from_centroid(xcentroid(b), ycentroid(b), w, h)


def dilate(b: Column, scale=1.0, x: bool = True, y: bool = True) -> Column:
    return resized(b, width(b) * (_d(scale) if x else 1), height(b) * (_d(scale) if y else 1))


def dilate_px(b: Column, px) -> Column:
    return grow(b, px, px, px, px)


def rescale(b: Column, sx=1.0, sy=None) -> Column:
    sy = sx if sy is None else sy
    return box(b["xmin"] * _d(sx), b["ymin"] * _d(sy), b["xmax"] * _d(sx), b["ymax"] * _d(sy))


def max_square(b: Column) -> Column:
    return resized(b, max_dim(b), max_dim(b))


def min_square(b: Column) -> Column:
    return resized(b, min_dim(b), min_dim(b))


def normalized(b: Column, w, h) -> Column:
    """Coordinates as shares of the image."""
    return box(F.try_divide(b["xmin"], _d(w)), F.try_divide(b["ymin"], _d(h)), F.try_divide(b["xmax"], _d(w)), F.try_divide(b["ymax"], _d(h)))


def fliplr(b: Column, w) -> Column:
    return box(_d(w) - b["xmax"], b["ymin"], _d(w) - b["xmin"], b["ymax"])


def flipud(b: Column, h) -> Column:
    return box(b["xmin"], _d(h) - b["ymax"], b["xmax"], _d(h) - b["ymin"])


def rot90cw(b: Column, h, w) -> Column:
    return from_xywh(_d(h) - b["ymax"], b["xmin"], height(b), width(b))


def rot90ccw(b: Column, h, w) -> Column:
    return from_xywh(b["ymin"], _d(w) - b["xmax"], height(b), width(b))


def affine(b: Column, m: Sequence[Sequence[float]]) -> Column:
    """Moves the centre by a 2x3 matrix; the size stays."""
    x, y = xcentroid(b), ycentroid(b)
    return from_centroid(m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2], width(b), height(b))


def projective(b: Column, m: Sequence[Sequence[float]]) -> Column:
    x, y = xcentroid(b), ycentroid(b)
    z = m[2][0] * x + m[2][1] * y + m[2][2]
    return from_centroid(F.try_divide(m[0][0] * x + m[0][1] * y + m[0][2], z), F.try_divide(m[1][0] * x + m[1][1] * y + m[1][2], z), width(b), height(b))


def known(a: Column, b: Column) -> Column:
    """Both are there; least() and greatest() would pass over a null."""
    return a["xmin"].isNotNull() & b["xmin"].isNotNull()


def intersection_area(a: Column, b: Column) -> Column:
    """Null if a box is."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.when(known(a, b), F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h))


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection_area(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap or partner."""
    u = union_area(a, b)
    return F.coalesce(F.when(u > 0, intersection_area(a, b) / u), F.lit(0.0))


def cover(a: Column, b: Column) -> Column:
    """Share of a that lies in b; 0 if a has no area."""
    return F.coalesce(F.when(area(a) > 0, intersection_area(a, b) / area(a)), F.lit(0.0))


def max_cover(a: Column, b: Column) -> Column:
    return F.greatest(cover(a, b), cover(b, a))


def shape_iou(a: Column, b: Column) -> Column:
    return iou(to_origin(a), to_origin(b))


def overlaps(a: Column, b: Column, gate: float = 0.0) -> Column:
    """False if a box is null."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return known(a, b) & (w > -gate) & (h > -gate)


def has_intersection(a: Column, b: Column, at_iou=None, at_cover=None, above_maxcover=None, at_bbcover=None, gate: float = 0.0) -> Column:
    """Overlap, and any of the thresholds given: iou, cover and bbcover from, maxcover above."""
    tests = [t for t in (
        at_iou is not None and iou(a, b) >= at_iou,
        at_cover is not None and cover(a, b) >= at_cover,
        above_maxcover is not None and max_cover(a, b) > above_maxcover,
        at_bbcover is not None and cover(b, a) >= at_bbcover,
    ) if t is not False]
    base = overlaps(a, b, gate)
    return base & reduce(lambda x, y: x | y, tests) if tests else base


def intersection(a: Column, b: Column) -> Column:
    """Null where they do not overlap."""
    i = box(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"]))
    return F.when(overlaps(a, b), i)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"]))


def union_agg(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return box(F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"]))


def mean_agg(b: Column) -> Column:
    return box(*[F.avg(c) for c in _p(b)])


def median_shape_agg(b: Column) -> Column:
    return F.struct(F.percentile(width(b), 0.5).alias("width"), F.percentile(height(b), 0.5).alias("height"))


def hull(points: Column) -> Column:
    """Box around array<struct<x,y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def inside(a: Column, b: Column) -> Column:
    """a lies wholly in b."""
    return overlaps(a, b) & (a["xmin"] >= b["xmin"]) & (a["ymin"] >= b["ymin"]) & (a["xmax"] <= b["xmax"]) & (a["ymax"] <= b["ymax"])


def holds_point(b: Column, x, y) -> Column:
    return (_d(x) >= b["xmin"]) & (_d(x) <= b["xmax"]) & (_d(y) >= b["ymin"]) & (_d(y) <= b["ymax"])


def frame(w, h) -> Column:
    return box(0, 0, w, h)


def in_image(b: Column, w, h) -> Column:
    return overlaps(b, frame(w, h))


def interior(b: Column, w, h, border: float = 1.0) -> Column:
    """Within the image shrunk about its centre to the share `border`."""
    return inside(b, dilate(frame(w, h), border))


def clip(b: Column, w, h) -> Column:
    """Part within the image; null if there is none."""
    return intersection(b, frame(w, h))


def to_interior(b: Column, w, h) -> Column:
    """Moved by the least needed to lie in the image, then clipped if too large; null if it lies outside."""
    t = translate(b, F.greatest(-b["xmin"], F.lit(0.0)), F.greatest(-b["ymin"], F.lit(0.0)))
    t = translate(t, -F.greatest(t["xmax"] - _d(w), F.lit(0.0)), -F.greatest(t["ymax"] - _d(h), F.lit(0.0)))
    return F.when(in_image(b, w, h), clip(t, w, h))


def sqdist(a: Column, b: Column) -> Column:
    """Of the upper left corners."""
    return F.pow(a["xmin"] - b["xmin"], 2) + F.pow(a["ymin"] - b["ymin"], 2)


def dist(a: Column, b: Column) -> Column:
    """Of the centres."""
    return F.sqrt(F.pow(xcentroid(a) - xcentroid(b), 2) + F.pow(ycentroid(a) - ycentroid(b), 2))


def pdist(a: Column, b: Column, sigma=None) -> Column:
    s = max_dim(a) if sigma is None else _d(sigma)
    return F.exp(-F.try_divide(sqdist(a, b), 2 * s * s))


def dx(a: Column, b: Column) -> Column:
    return b["xmin"] - a["xmin"]


def dy(a: Column, b: Column) -> Column:
    return b["ymin"] - a["ymin"]


def shape_dist(a: Column, b: Column) -> Column:
    return F.abs(width(a) - width(b)) + F.abs(height(a) - height(b))


def average(boxes: Column) -> Column:
    """Mean corners of an array of boxes."""
    m = lambda f: F.try_divide(F.aggregate(boxes, F.lit(0.0), lambda s, b: s + b[f]), F.size(boxes).cast("double"))
    return box(m("xmin"), m("ymin"), m("xmax"), m("ymax"))


def average_shape(b: Column, others: Column) -> Column:
    """Mean size of b and the others about the centre of b."""
    every = F.array_append(others, b)
    m = lambda f: F.aggregate(every, F.lit(0.0), lambda s, x: s + f(x)) / F.size(every)
    return resized(b, m(width), m(height))


def grid(b: Column, rows: int, cols: int) -> Column:
    """rows x cols cells, columns first, as an array."""
    i = F.sequence(F.lit(0), F.lit(cols - 1))
    j = F.sequence(F.lit(0), F.lit(rows - 1))
    w, h = width(b) / cols, height(b) / rows
    return F.flatten(F.transform(i, lambda x: F.transform(j, lambda y: from_xywh(b["xmin"] + x * w, b["ymin"] + y * h, w, h))))


def ellipse(b: Column) -> Column:
    """Inscribed ellipse: semi-axes, centre and angle."""
    return F.struct((width(b) / 2).alias("major"), (height(b) / 2).alias("minor"), xcentroid(b).alias("x"), ycentroid(b).alias("y"), F.lit(0.0).alias("phi"))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    """Corner by corner between a (t = 0) and b (t = 1)."""
    return box(*[p + (q - p) * t for p, q in zip(_p(a), _p(b))])
