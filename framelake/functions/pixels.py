"""Small dense grids: array<array<double>> as rows of values. Pure expressions, no Python.

Decoding of image files needs libraries that are not part of this project; grids come from tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.size(F.element_at(g, 1))


def from_flat(values: Column, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(values.cast("array<double>"), i * cols + 1, F.lit(cols)))


def flat(g: Column) -> Column:
    return F.flatten(g)


def each(g: Column, f) -> Column:
    return F.transform(g, lambda r: F.transform(r, f))


def fliplr(g: Column) -> Column:
    return F.transform(g, F.reverse)


def flipud(g: Column) -> Column:
    return F.reverse(g)


def transpose(g: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), width(g)), lambda j: F.transform(g, lambda r: F.element_at(r, j)))


def rot90cw(g: Column) -> Column:
    return fliplr(transpose(g))


def rot90ccw(g: Column) -> Column:
    return flipud(transpose(g))


def crop(g: Column, x: int, y: int, w: int, h: int) -> Column:
    return F.transform(F.slice(g, y + 1, h), lambda r: F.slice(r, x + 1, w))


def pad(g: Column, w: int, h: int, value=0.0) -> Column:
    """w columns and h rows of a value on every side."""
    v = F.lit(float(value)) if isinstance(value, (int, float)) else value
    side = F.array_repeat(v, w)
    rows = F.transform(g, lambda r: F.concat(side, r, side))
    blank = F.array_repeat(F.array_repeat(v, width(g) + 2 * w), h)
    return F.concat(blank, rows, blank)


def mean_pad(g: Column, w: int, h: int) -> Column:
    return pad(g, w, h, mean(g))


def center_crop(g: Column, w: int, h: int, gw: int, gh: int) -> Column:
    return crop(g, (gw - w) // 2, (gh - h) // 2, w, h)


def paste(g: Column, patch: Column, x: int, y: int, w: int, h: int) -> Column:
    """g with a w x h patch whose upper left corner lies at (x, y)."""
    return F.transform(g, lambda r, i: F.when((i < y) | (i >= y + h), r).otherwise(F.concat(F.slice(r, 1, x), F.element_at(patch, F.greatest(i - y + 1, F.lit(1))), F.slice(r, x + w + 1, F.greatest(F.size(r) - x - w, F.lit(0))))))


def total(g: Column) -> Column:
    return F.aggregate(F.flatten(g), F.lit(0.0), lambda s, x: s + x)


def minimum(g: Column) -> Column:
    return F.array_min(F.flatten(g))


def maximum(g: Column) -> Column:
    return F.array_max(F.flatten(g))


def mean(g: Column) -> Column:
    return F.try_divide(total(g), F.size(F.flatten(g)).cast("double"))


def std(g: Column) -> Column:
    m = mean(g)
    return F.sqrt(F.aggregate(F.flatten(g), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(F.flatten(g)))


def gain(g: Column, k: float) -> Column:
    return each(g, lambda x: x * k)


def bias(g: Column, b: float) -> Column:
    return each(g, lambda x: x + b)


def normalize(g: Column, k: float, b: float) -> Column:
    return each(g, lambda x: x * k + b)


def to_gray(g: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Values brought from lo .. hi (default: the grid's own range) to 0 .. 1 and cut there."""
    lo, hi = minimum(g) if lo is None else lo, maximum(g) if hi is None else hi
    return each(g, lambda x: F.least(F.greatest(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def saturate(g: Column, lo: float, hi: float) -> Column:
    return each(g, lambda x: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def sum_to_one(g: Column, eps: float = 1e-6) -> Column:
    s = total(g) + eps
    return each(g, lambda x: x / s)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x * (1 - alpha) + y * alpha))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 luma of three grids."""
    rg = F.zip_with(r, g, lambda x, y: F.zip_with(x, y, lambda u, v: u * 0.299 + v * 0.587))
    return F.zip_with(rg, b, lambda x, y: F.zip_with(x, y, lambda u, v: u + v * 0.114))


def box_blur(g: Column, radius: int) -> Column:
    """Mean over the square of the given radius, cut at the border."""
    n = lambda a, i: F.slice(a, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius, F.size(a) - 1) - F.greatest(i - radius, F.lit(0)) + 1)
    return F.transform(g, lambda r, i: F.transform(r, lambda _, j: mean(F.transform(n(g, i), lambda q: n(q, j)))))


def mask(w: int, h: int, box: Column) -> Column:
    """h x w grid of 1 within the box, 0 outside (cells by their upper left corner)."""
    xs, ys = F.sequence(F.lit(0), F.lit(w - 1)), F.sequence(F.lit(0), F.lit(h - 1))
    inside = lambda x, y: (x >= box["xmin"]) & (x < box["xmax"]) & (y >= box["ymin"]) & (y < box["ymax"])
    return F.transform(ys, lambda y: F.transform(xs, lambda x: F.when(inside(x, y), 1.0).otherwise(0.0)))


def apply_mask(g: Column, m: Column, value) -> Column:
    """g with a value wherever the mask is not zero."""
    v = F.lit(float(value)) if isinstance(value, (int, float)) else value
    return F.zip_with(g, m, lambda r, s: F.zip_with(r, s, lambda x, y: F.when(y != 0, v).otherwise(x)))


def pixelate(g: Column, size: int) -> Column:
    """Each cell takes the value of the upper left cell of its block."""
    return F.transform(g, lambda r, i: F.transform(r, lambda x, j: F.get(F.get(g, (i - i % size)), (j - j % size))))


def tiles(w, h, tw: int, th: int, ox: int = 0, oy: int = 0) -> Column:
    """Boxes of the tiles of a w x h image, with the given overlaps, row by row; whole tiles only."""
    from framelake.functions import box as B

    xs = F.sequence(F.lit(0), w - tw, F.lit(tw - ox))
    ys = F.sequence(F.lit(0), h - th, F.lit(th - oy))
    made = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: B.from_xywh(x, y, F.lit(tw), F.lit(th)))))
    return F.when((w >= tw) & (h >= th), made)


def montage_place(k: Column, n: Column) -> Column:
    """Grid row and column of item k of n in a square montage."""
    m = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    return F.struct(F.floor(k / m).alias("row"), F.pmod(k, m).alias("col"))


def dhash(g: Column, k: int) -> Column:
    """2 k^2 gradient signs of a (k + 1) x (k + 1) grid, dy before dx cell by cell, as a text of 0 and 1.

    The gradient is central within the grid and one-sided at its first row and column; the last row
    and column give no bits."""

    def at(i, j):
        return F.get(F.get(g, i), j)

    def sign(a, b):
        return F.when(a - b > 0, "1").otherwise("0")

    i = F.sequence(F.lit(0), F.lit(k - 1))
    before = lambda x: F.greatest(x - 1, F.lit(0))
    cell = lambda y, x: F.concat(sign(at(y + 1, x), at(before(y), x)), sign(at(y, x + 1), at(y, before(x))))
    return F.array_join(F.flatten(F.transform(i, lambda y: F.transform(i, lambda x: cell(y, x)))), "")


def words_of(bits: Column, n: int, size: int = 32) -> Column:
    """Text of bits as an array of bigints of `size` bits each."""
    return F.array(*[F.conv(F.substring(bits, at + 1, size), 2, 10).cast("bigint") for at in range(0, n, size)])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_pairs(df: DataFrame, key: str, bits: str, n: int, below: int) -> DataFrame:
    """(key_a, key_b, distance): all pairs of texts of n bits that differ in fewer than `below`.

    The bits are cut into at least `below` bands; two that differ in fewer bits agree in a band, so an
    equi-join on (band, value) finds every pair. The wider the bands, the fewer pairs are tried in
    vain: n should be many times `below`. Equal texts are compared once, by their smallest key, and
    expanded to all their keys at the end; a text held k times gives k (k - 1) / 2 pairs by itself."""
    size = max(1, n // below)
    spans = [(i, min(size, n - i)) for i in range(0, n, size)]
    df = df.where(F.col(bits).isNotNull())
    reps = df.groupBy(bits).agg(F.min(key).alias(key)).select(key, bits, words_of(F.col(bits), n, 63).alias("w"))
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.substring(bits, at + 1, k).alias("v")) for i, (at, k) in enumerate(spans)])).alias("band")
    count = -(-n // 63)
    side = lambda x: reps.select(F.col(key).alias(f"key_{x}"), *[F.get("w", F.lit(i)).alias(f"{x}{i}") for i in range(count)], bands)
    distance = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, count)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    j = side("a").join(side("b"), "band").where((F.col("key_a") < F.col("key_b")) & (distance < below))
    close = j.select("key_a", "key_b", distance.alias("distance")).distinct()
    same = reps.select(F.col(key).alias("key_a"), F.col(key).alias("key_b"), F.lit(0).alias("distance"))
    classes = hamming_classes(df, key, bits)
    members = lambda x: classes.select(F.col("representative").alias(f"key_{x}"), F.col(key).alias(x))
    every = close.unionByName(same).join(members("a"), "key_a").join(members("b"), "key_b").where((F.col("key_a") != F.col("key_b")) | (F.col("a") < F.col("b")))
    return every.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "distance")


def hamming_classes(df: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, representative): the smallest key with the same text."""
    reps = df.groupBy(bits).agg(F.min(key).alias("representative"))
    return df.select(key, bits).join(reps, bits).select(key, "representative")


def ssim(a: Column, b: Column, span: float = 1.0) -> Column:
    """Structural similarity of two grids from their global means, variances and covariance."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    x, y = F.flatten(a), F.flatten(b)
    n = F.size(x).cast("double")
    ma, mb = mean(a), mean(b)
    va = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - ma) * (v - ma)) / n
    vb = F.aggregate(y, F.lit(0.0), lambda s, v: s + (v - mb) * (v - mb)) / n
    cov = F.aggregate(F.zip_with(x, y, lambda u, v: (u - ma) * (v - mb)), F.lit(0.0), lambda s, v: s + v) / n
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def checkerboard(dx: int, dy: int, rows: int, cols: int) -> Column:
    ys, xs = F.sequence(F.lit(0), F.lit(dy * rows - 1)), F.sequence(F.lit(0), F.lit(dx * cols - 1))
    return F.transform(ys, lambda y: F.transform(xs, lambda x: F.pmod(F.floor(y / dy) + F.floor(x / dx), F.lit(2)).cast("double")))


def circle(x: float, y: float, r: float, w: int, h: int) -> Column:
    ys, xs = F.sequence(F.lit(0), F.lit(h - 1)), F.sequence(F.lit(0), F.lit(w - 1))
    return F.transform(ys, lambda j: F.transform(xs, lambda i: F.when(F.pow(i - x, 2) + F.pow(j - y, 2) <= r * r, 1.0).otherwise(0.0)))


def vertical_gradient(rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.array_repeat(i / max(1, rows - 1), cols))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _weighted(row: Column, taps: list[tuple[float, Column]]) -> Column:
    parts = [w * F.get(row, i) for w, i in taps]
    return sum(parts[1:], parts[0])


def _reflected(i: Column, n: int) -> Column:
    """Place i of a line of n mirrored at its ends, which are not repeated."""
    return F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i)


def gaussian_blur(g: Column, h: int, w: int, sigma: float = 1.0) -> Column:
    """Blur with a Gaussian of five taps each way, not brought to sum one, edges mirrored."""
    weight = {k: math.exp(-0.5 * (k / sigma) ** 2) / math.sqrt(2 * math.pi) for k in range(-2, 3)}
    line = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = F.transform(g, lambda r: F.transform(line(w), lambda x: _weighted(r, [(weight[k], _reflected(x + k, w)) for k in weight])))
    down = lambda rs: F.transform(line(h), lambda y: F.transform(line(w), lambda x: sum((weight[k] * F.get(F.get(rs, _reflected(y + k, h)), x) for k in sorted(weight)), F.lit(0.0))))
    return _let(rows, down)


def halved(g: Column) -> Column:
    """Every second row and column."""
    even = lambda a: F.filter(a, lambda _, i: F.pmod(i, F.lit(2)) == 0)
    return F.transform(even(g), even)


def gaussian_pyramid(g: Column, h: int, w: int) -> list[Column]:
    """Blurred grids, each half as large as the one before, log2(shorter side) - 2 of them, and the rest."""
    bands = []
    for _ in range(max(0, int(math.log2(min(h, w)) - 2))):
        y = gaussian_blur(g, h, w)
        bands.append(y)
        g, h, w = halved(y), -(-h // 2), -(-w // 2)
    return [*bands, g]


def laplacian_pyramid(g: Column, h: int, w: int) -> list[Column]:
    """What each blur of the Gaussian pyramid takes away, and the rest: bands that add up again."""
    bands = []
    for _ in range(max(0, int(math.log2(min(h, w)) - 2))):
        y = gaussian_blur(g, h, w)
        bands.append(F.zip_with(g, y, lambda a, b: F.zip_with(a, b, lambda u, v: u - v)))
        g, h, w = halved(y), -(-h // 2), -(-w // 2)
    return [*bands, g]


def resized(g: Column, h: int, w: int, rows: int, cols: int, nearest: bool = False) -> Column:
    """Grid of h x w brought to rows x cols, linear between the middles of the cells (or the nearest cell)."""

    def taps(i: Column, n: int, m: int) -> tuple[Column, Column, Column]:
        at = F.greatest(F.lit(0.0), F.least((i + 0.5) * n / m - 0.5, F.lit(float(n - 1))))
        lo = F.floor(at).cast("int")
        return lo, F.least(lo + 1, F.lit(n - 1)), at - lo

    cell = lambda y, x: F.get(F.get(g, y), x)

    def value(i: Column, j: Column) -> Column:
        if nearest:
            return cell(F.floor((i + 0.5) * h / rows).cast("int"), F.floor((j + 0.5) * w / cols).cast("int"))
        y0, y1, ty = taps(i, h, rows)
        x0, x1, tx = taps(j, w, cols)
        top, low = cell(y0, x0) * (1 - tx) + cell(y0, x1) * tx, cell(y1, x0) * (1 - tx) + cell(y1, x1) * tx
        return top * (1 - ty) + low * ty

    line = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(line(rows), lambda i: F.transform(line(cols), lambda j: value(i, j)))


def noised(g: Column, key: Column, amount: float, seed: int = 0) -> Column:
    """Uniform noise of +-amount on every cell, the same in every run: by a hash of the key and the place."""
    unit = lambda i, j: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5)
    return F.transform(g, lambda r, i: F.transform(r, lambda v, j: v + 2 * amount * unit(i, j)))
