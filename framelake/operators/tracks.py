"""Tracks: boxes at key frames, linear in between. Frames carry columns video, track, frame, box, conf."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators.joins import interval_join
from framelake.session import cut

T = ["video_id", "track_id"]


def _order() -> Window:
    return Window.partitionBy(*T).orderBy("frame")


def spans(keys: DataFrame) -> DataFrame:
    """Key boxes with the next one's frame and box (null at a track's end)."""
    return keys.withColumn("next_frame", F.lead("frame").over(_order())).withColumn("next_box", F.lead("box").over(_order()))


def dense(keys: DataFrame, step: int = 1) -> DataFrame:
    """A box for every step-th frame from the first to the last key frame, which is always there.

    Each span yields its own frames, so one window over key frames is all that is shuffled."""
    s = spans(keys)
    first = F.min("frame").over(Window.partitionBy(*T))
    s = s.withColumn("_f", first)
    lo = F.col("_f") + F.ceil((F.col("frame") - F.col("_f")) / step) * step
    hi = F.col("next_frame") - 1
    at = F.when(F.col("next_frame").isNull(), F.array(F.col("frame"))).when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    e = s.withColumn("at", F.explode(at.cast("array<int>")))
    conf = F.col("conf") if "conf" in keys.columns else F.lit(None).cast("double")
    return e.select(*T, F.col("at").alias("frame"), _between(e).alias("box"), conf.alias("conf"), (F.col("at") == F.col("frame")).alias("is_key"))


def _between(e: DataFrame, at: str = "at") -> Column:
    t = F.try_divide(F.col(at) - F.col("frame"), F.greatest(F.col("next_frame") - F.col("frame"), F.lit(1)).cast("double"))
    return F.when(F.col("next_frame").isNull() | (F.col(at) == F.col("frame")), F.col("box")).otherwise(B.interpolate(F.col("box"), F.col("next_box"), t))


def at_frames(keys: DataFrame, wanted: DataFrame, boundary: str = "strict") -> DataFrame:
    """Boxes of tracks at wanted (video_id, track_id, at) frames.

    strict: null outside start - 1 .. end (the frame before the first still gives the first box);
    extend: the first or last box. An as-of join by union and one window."""
    s = spans(keys).select(*T, F.col("frame").alias("_t"), F.lit(0).alias("_side"), F.struct("frame", "box", "next_frame", "next_box").alias("k"))
    w = wanted.select(*T, F.col("at").alias("_t"), F.lit(1).alias("_side"))
    u = s.unionByName(w, allowMissingColumns=True)
    back = Window.partitionBy(*T).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = Window.partitionBy(*T)
    u = u.withColumn("p", F.last("k", ignorenulls=True).over(back)).withColumn("f", F.min_by("k", F.col("k.frame")).over(ends)).withColumn("e", F.max("k.frame").over(ends))
    u = u.where("_side = 1").withColumn("q", F.coalesce("p", "f")).select(*T, F.col("_t").alias("at"), "q.*", "e", F.col("f.frame").alias("s"))
    inside = (F.col("at") >= F.col("s") - 1) & (F.col("at") <= F.col("e"))
    got = F.when(F.col("at") < F.col("s"), F.col("box")).when(F.col("at") > F.col("e"), F.col("box")).otherwise(_between(u))
    return u.select(*T, "at", (got if boundary == "extend" else F.when(inside, got)).alias("box"))


def during(s: Column, e: Column, f: Column) -> Column:
    """True from the frame before the first to the last."""
    return (f >= s - 1) & (f <= e)


def during_interval(s: Column, e: Column, f1: Column, f2: Column) -> Column:
    return (s <= f2) & (e >= f1)


def reframe(keys: DataFrame, factor: float) -> DataFrame:
    """Key frames at another rate, rounded half to even; of frames that fall together the first stays."""
    r = keys.withColumn("frame", F.rint(F.col("frame") * factor).cast("int"))
    return r.groupBy(*T, "frame").agg(F.min_by("box", "box").alias("box"), F.max("conf").alias("conf"))


def shift(keys: DataFrame, frames: int = 0, dx: float = 0, dy: float = 0) -> DataFrame:
    return keys.withColumn("frame", F.col("frame") + frames).withColumn("box", B.translate(F.col("box"), dx, dy))


def stats(keys: DataFrame, fps: float = 30.0) -> DataFrame:
    """Per track: frames, key boxes, length, duration, mean box and shape, path, closure, confidence."""
    prev = F.lag("box").over(_order())
    k = keys.withColumn("_step", F.coalesce(B.dist(F.col("box"), prev), F.lit(0.0)))
    b = F.col("box")
    area = B.area(b)
    g = k.groupBy(*T).agg(
        F.min("frame").alias("startframe"), F.max("frame").alias("endframe"), F.count(F.lit(1)).alias("keyframes"), B.mean_agg(b).alias("meanbox"), B.union_agg(b).alias("unionbox"),
        F.avg(B.width(b)).alias("mean_width"), F.avg(B.height(b)).alias("mean_height"), F.var_pop(B.width(b)).alias("var_width"), F.var_pop(B.height(b)).alias("var_height"),
        F.sum("_step").alias("pathlength"), F.min_by("box", "frame").alias("startbox"), F.max_by("box", "frame").alias("endbox"),
        F.min(area).alias("smallest_area"), F.max(area).alias("biggest_area"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"),
    )
    g = g.withColumn("length", F.col("endframe") - F.col("startframe") + 1)
    return g.withColumn("duration", F.col("length") / fps).withColumn("closure", B.dist(F.col("startbox"), F.col("endbox"))).withColumn("moving", B.max_cover(F.col("startbox"), F.col("endbox")) < 0.9)


def smooth(keys: DataFrame, width: int) -> DataFrame:
    """Each key box averaged with the following ones up to `width` in all, itself counted twice; a
    track's last width - 1 boxes, which lack followers, are left out."""
    w = _order().rowsBetween(0, width - 1)
    mean = lambda f: (F.sum(F.col("box")[f]).over(w) + F.col("box")[f]) / (width + 1)
    k = keys.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_b", B.box(*[mean(f) for f in ("xmin", "ymin", "xmax", "ymax")]))
    return k.where(F.col("_n") == width).withColumn("box", F.col("_b")).drop("_n", "_b")


def velocity(frames: DataFrame, dt: int) -> DataFrame:
    """For dense frames: mean over k = 1 .. dt - 1 of the centre's (and size's) change over k frames, by k.

    A track covers the frame before its first one, with its first box, so that frame counts as well."""
    w = _order()
    place = F.row_number().over(w)
    quantities = {"vx": B.xcentroid(F.col("box")), "vy": B.ycentroid(F.col("box")), "vw": B.width(F.col("box")), "vh": B.height(F.col("box"))}
    f = frames.withColumns({f"_{n}": c for n, c in quantities.items()})
    out = {}
    for n in quantities:
        before = lambda k, n=n: F.when(place == k, F.first(f"_{n}").over(w)).otherwise(F.lag(f"_{n}", k).over(w))
        terms = F.array(*[(F.col(f"_{n}") - before(k)) / k for k in range(1, dt)])
        have = F.filter(terms, lambda x: x.isNotNull())
        out[n] = F.coalesce(F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have).cast("double")), F.lit(0.0))
    f = f.withColumns(out).drop(*[f"_{n}" for n in quantities])
    return f.withColumns({"speed": F.hypot("vx", "vy"), "bearing": F.when(F.hypot("vx", "vy") > 0, F.atan2("vy", "vx"))})


def acceleration(frames: DataFrame, dt: int) -> DataFrame:
    """Size of the change of velocity between dt frames before and 2 dt frames after, by 2 dt; null at the ends."""
    v, w = velocity(frames, dt), _order()
    d = lambda n: (F.lead(n, 2 * dt).over(w) - F.lag(n, dt).over(w)) / (2 * dt)
    return v.withColumn("acceleration", F.hypot(d("vx"), d("vy")))


def bearing_change(frames: DataFrame, dt: int, min_speed: float = 0.0) -> DataFrame:
    """Per track: sum of the changes of bearing, brought to -pi .. pi."""
    v = velocity(frames, dt).where(F.col("speed") > min_speed)
    v = v.withColumn("_d", F.coalesce(F.col("bearing") - F.lag("bearing").over(_order()), F.lit(0.0)))
    s, tau = F.sum("_d"), 2 * F.pi()
    return v.groupBy(*T).agg(s.alias("_s")).select(*T, F.when(F.abs("_s") <= F.pi(), F.col("_s")).when(F.col("_s") > 0, tau - F.col("_s")).otherwise(tau + F.col("_s")).alias("bearing_change"))


def extrapolate(keys: DataFrame, ahead: int) -> DataFrame:
    """Constant velocity from a track's last two key boxes, `ahead` frames beyond the last."""
    last = keys.withColumn("_r", F.row_number().over(Window.partitionBy(*T).orderBy(F.desc("frame")))).where("_r <= 2")
    g = last.groupBy(*T).agg(F.max_by("box", "frame").alias("b"), F.max("frame").alias("f"), F.min_by("box", "frame").alias("a"), F.min("frame").alias("e"))
    rate = lambda q: F.coalesce(F.try_divide(q(F.col("b")) - q(F.col("a")), F.col("f") - F.col("e")), F.lit(0.0)) * ahead
    return g.select(*T, (F.col("f") + ahead).alias("frame"), B.translate(F.col("b"), rate(B.xcentroid), rate(B.ycentroid)).alias("box"))


#: Blocks a video is cut into at least (where two sets of tracks meet, those of one), tracks of a block at most, and
#: boxes that a block may fill in.
BLOCKS, BLOCKS_OF_TWO, MOST_TRACKS, MOST_BOXES = 8, 4, 9216, 3_000_000
#: Boxes measured at once: what the processor's cache holds.
CHUNK = 32_768
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _blocks(keys: DataFrame, by: list[str], blocks: int = BLOCKS) -> DataFrame:
    """One row a track: by, track_id, its span, its key boxes in order (frames and corners as lists), and
    its block: tracks in order of their starts, as many as their frames permit."""
    box = [F.col("box")[c].alias(c) for c in CORNERS]
    whole = keys.groupBy(*by, "track_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.array_sort(F.collect_list(F.struct("frame", *box))).alias("k"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("lo", "track_id")) - 1
    group = Window.partitionBy(*by)
    frames = F.max("hi").over(group) - F.min("lo").over(group) + 1
    size = F.greatest(F.lit(8), F.least(F.greatest(F.lit(32), F.ceil(F.count(F.lit(1)).over(group) / blocks)), F.lit(MOST_TRACKS), F.floor(F.lit(MOST_BOXES) / frames)))
    whole = whole.withColumn("block", F.floor(place / size))
    return cut(whole.select(*by, "track_id", "lo", "hi", "block", F.col("k.frame").alias("at"), *[F.col(f"k.{c}").alias(c) for c in CORNERS]))


class _Side:
    """Tracks of a block in order of their starts, with a box for every frame of start .. end (corners and area by
    track and frame); where a track has none, one that meets nothing. lo, hi: places of its first and last frame."""

    def __init__(self, t: pa.Table, start: int, end: int):
        t = t.sort_by([("lo", "ascending"), ("track_id", "ascending")]).combine_chunks()
        lists = lambda c: t.column(c).combine_chunks()
        cut_at, at = lists("at").offsets.to_numpy(), lists("at").values.to_numpy().astype(np.int64)
        corners = np.stack([lists(c).values.to_numpy(zero_copy_only=False) for c in CORNERS])
        self.ids, n, width = t.column("track_id"), len(t), end - start + 1
        self.lo, self.hi = (t.column(c).to_numpy().astype(np.int64) - start for c in ("lo", "hi"))
        self.box = np.empty((5, n, width))
        self.box[0], self.box[1], self.box[2], self.box[3], self.box[4] = np.inf, 0.0, -np.inf, 0.0, 1.0
        for i in range(n):
            f, p = at[cut_at[i] : cut_at[i + 1]], corners[:, cut_at[i] : cut_at[i + 1]]
            first = max(0, int(np.searchsorted(f, start, "right")) - 1)
            last = min(len(f), int(np.searchsorted(f, end, "left")) + 1)
            f, p = f[first:last], p[:, first:last]
            step = np.diff(f)
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = (p[:, 1:] - p[:, :-1]) / step
            of = np.repeat(np.arange(len(step)), step)
            b = np.concatenate([slope[:, of] * (np.arange(f[0], f[-1]) - f[of]) + p[:, of], p[:, -1:]], axis=1)
            own = slice(max(f[0], start) - f[0], min(f[-1], end) - f[0] + 1)
            there = slice(max(f[0], start) - start, min(f[-1], end) - start + 1)
            if there.start < there.stop:
                self.box[:4, i, there] = b[:, own]
                self.box[4, i, there] = (b[2, own] - b[0, own]) * (b[3, own] - b[1, own])


def _intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common areas of boxes (corners first)."""
    x = np.minimum(a[2], b[2])
    x -= np.maximum(a[0], b[0])
    np.maximum(x, 0.0, out=x)
    y = np.minimum(a[3], b[3])
    y -= np.maximum(a[1], b[1])
    np.maximum(y, 0.0, out=y)
    x *= y
    return x


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(iou, larger cover) of boxes (corners and area first); 0 where they do not meet."""
    x = _intersection(a, b)
    y = a[4] + b[4]
    y -= x
    np.maximum(y, 1e-300, out=y)
    iou = np.divide(x, y, out=y)
    least = np.minimum(a[4], b[4])
    np.maximum(least, 1e-300, out=least)
    return iou, np.divide(x, least, out=x)


def _top(values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Mean of the k largest of each row of values, of which none is negative."""
    total = values.sum(1)
    many = np.flatnonzero(np.count_nonzero(values, axis=1) > k)
    if len(many):
        best = np.sort(values[many], axis=1)[:, ::-1].cumsum(1)
        total[many] = best[np.arange(len(many)), k[many] - 1]
    return total / k


def _all_pairs(left: _Side, right: _Side, own: bool) -> Iterator[tuple[int | np.ndarray, slice | np.ndarray]]:
    """Each track of left with runs of tracks of right; of one block each pair once."""
    run = max(1, CHUNK // left.box.shape[2])
    for j in range(0, len(right.lo), run):
        for i in range(min(len(left.lo), j + run - 1) if own else len(left.lo)):
            yield i, slice(max(j, i + 1) if own else j, min(j + run, len(right.lo)))


#: Tracks that one is met with at once at its own frames.
TRACKS = 128


class _Tile:
    """Overlaps of a track's boxes with those of others at the same frames, in memory used again and again."""

    def __init__(self, *sides: _Side):
        self.memory, self.zero = np.empty((3, 0)), np.zeros(0)
        self.guard = any(not (x.box[4] > 0).all() for x in sides)

    def __call__(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(iou, larger cover) of boxes (corners, area and its inverse first), by other track and frame."""
        shape = b[0].shape
        n = shape[0] * shape[1]
        if n > self.memory.shape[1]:
            self.memory = np.empty((3, n))
        if shape[1] > len(self.zero):
            self.zero = np.zeros(shape[1])
        x, y, z = (m[:n].reshape(shape) for m in self.memory)
        zero = self.zero[: shape[1]]  # two arrays are compared faster than one and a number
        np.minimum(a[2], b[2], out=x)
        x -= np.maximum(a[0], b[0], out=y)
        np.maximum(x, zero, out=x)
        np.minimum(a[3], b[3], out=y)
        y -= np.maximum(a[1], b[1], out=z)
        np.maximum(y, zero, out=y)
        x *= y
        np.add(a[4], b[4], out=y)
        y -= x
        if self.guard:
            np.maximum(y, 1e-300, out=y)
        np.divide(x, y, out=y)
        x *= np.maximum(a[5], b[5], out=z)
        return y, x


def _with_inverse(box: np.ndarray) -> list[np.ndarray]:
    """Corners, area and its inverse."""
    return [*box, 1.0 / np.maximum(box[4], 1e-300)]


def _met(iou: np.ndarray) -> np.ndarray:
    """By row: how many are not 0."""
    hit = np.zeros((iou.shape[0], -(-iou.shape[1] // 8) * 8), bool)
    np.not_equal(iou, 0.0, out=hit[:, : iou.shape[1]])
    return np.bitwise_count(hit.view(np.uint64)).sum(1, dtype=np.int32)


def _sums(left: _Side, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tracks of left and right (of one block each pair once) with frames in common: their places, sums of IoU
    and cover and the largest IoU over all frames, and in how many frames they meet."""
    tile, a, n, width = _Tile(left, right), _with_inverse(left.box), len(right.lo), left.box.shape[2]
    run = max(1, min(CHUNK // width, 2 * TRACKS))
    for j in range(0, n, run):
        jj = np.arange(j, min(j + run, n))
        ii = np.arange(min(len(left.lo), jj[-1]) if own else len(left.lo))
        b = _with_inverse(right.box[:, j : jj[-1] + 1])
        sums, meets = np.zeros((3, len(ii), len(jj))), np.zeros((len(ii), len(jj)), np.int32)
        start, stop = max(0, right.lo[jj].min()), min(width, right.hi[jj].max() + 1)
        for i in ii:
            f, e, c = max(start, left.lo[i]), min(stop, left.hi[i] + 1), max(0, i + 1 - j) if own else 0
            if f < e:
                iou, cover = tile([x[i, f:e] for x in a], [x[c:, f:e] for x in b])
                sums[0, i, c:], sums[1, i, c:] = np.add.reduce(iou, axis=1), np.add.reduce(cover, axis=1)
                sums[2, i, c:], meets[i, c:] = np.maximum.reduce(iou, axis=1), _met(iou)
        there = np.maximum(left.lo[ii, None], right.lo[None, jj]) <= np.minimum(left.hi[ii, None], right.hi[None, jj])
        x, y = np.nonzero(there & (jj > ii[:, None]) if own else there)
        if len(x):
            yield x, jj[y], sums[:, x, y], meets[x, y]


def _sampled_sums(left: _Side, right: _Side, own: bool, step: int, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tracks of left and right (of one block each pair once) with more than a frame in common: their places;
    sums of IoU and cover over every `step`-th frame before the end of the common span, over `samples` of it
    and its end, and the IoU at both ends; in how many of each frames they meet.

    The frames depend on the later of two starts, so a track meets those that start before it, at its own
    frames alone; of the others every step-th frame lies side by side."""
    tile, width = _Tile(left, right), left.box.shape[2]
    sides = [(left, _with_inverse(left.box))]
    sides += sides if own else [(right, _with_inverse(right.box))]
    for turn in (False,) if own else (False, True):
        (one, a), (two, b) = sides[::-1] if turn else sides
        before = np.arange(len(one.lo)) if own else np.searchsorted(two.lo, one.lo, "left" if turn else "right")
        for j in range(0, before.max(), TRACKS):
            first = int(np.searchsorted(before, j, "right"))
            ii, jj = np.arange(first, len(one.lo)), np.arange(j, min(j + TRACKS, before.max()))
            e = np.minimum(one.hi[ii, None], two.hi[None, jj])
            length = e - one.lo[ii, None]
            there = (length > 0) & (jj < before[ii, None])
            x, y = np.nonzero(there)
            if not len(x):
                continue
            sums, meets = np.zeros((6, len(ii), len(jj))), np.zeros((2, len(ii), len(jj)), np.int32)
            ends = np.zeros((2, len(ii), len(jj)))
            for k in range(0, len(x), CHUNK):
                r, c = x[k : k + CHUNK], y[k : k + CHUNK]
                at = e[r, c]
                ends[:, r, c] = [z[:, 0] for z in tile([u[ii[r], at][:, None] for u in a], [u[jj[c], at][:, None] for u in b])]
            every = np.maximum(1, length // samples)
            apart: dict[tuple[int, int], list[np.ndarray]] = {}

            def meet(t: int, of: int, stop: int, some: slice | np.ndarray, one: _Side = one, a: list = a, b: list = b, jj: np.ndarray = jj, apart: dict = apart) -> tuple[np.ndarray, np.ndarray]:
                s = int(one.lo[t])
                if (of, s % of) not in apart:
                    apart[of, s % of] = [np.ascontiguousarray(u[jj[0] : jj[-1] + 1, s % of :: of]) for u in b]
                mine = [u[t, s:stop:of] for u in a]
                return tile([np.ascontiguousarray(u) for u in mine], [u[some, s // of : s // of + len(mine[0])] for u in apart[of, s % of]])

            for r, t in enumerate(ii):
                c = min(len(jj), before[t] - j)
                valid = there[r, :c]
                if not valid.any():
                    continue
                stop = min(one.hi[t], width)
                iou, cover = meet(t, step, stop, slice(0, c))
                sums[4, r, :c] = iou[:, 0]
                end = np.flatnonzero((length[r, :c] % step == 0) & valid & (e[r, :c] < stop))
                iou[end, length[r, end] // step] = cover[end, length[r, end] // step] = 0
                sums[0, r, :c], sums[1, r, :c], meets[0, r, :c] = np.add.reduce(iou, axis=1), np.add.reduce(cover, axis=1), _met(iou)
                kinds = every[r, :c][valid]
                for dt in np.unique(kinds):
                    some = slice(0, c) if len(kinds) == c and (kinds == dt).all() else np.flatnonzero((every[r, :c] == dt) & valid)
                    iou, cover = meet(t, int(dt), min(one.hi[t] + 1, width), some)
                    sums[2, r, some], sums[3, r, some], meets[1, r, some] = np.add.reduce(iou, axis=1), np.add.reduce(cover, axis=1), _met(iou)
            between = (length % every != 0) & there
            sums[5] = ends[0]
            sums[2:4] += ends * between
            meets[1] += (ends[0] != 0) & between
            i, k = ii[x], jj[y]
            yield (k, i, sums[:, x, y], meets[:, x, y]) if turn else (i, k, sums[:, x, y], meets[:, x, y])


def _sieve(least: float, frames: int = 16) -> Callable:
    """Pairs of tracks whose IoU exceeds `least` at each of some frames that they have in common."""

    def pairs(left: _Side, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.unique(np.linspace(0, left.box.shape[2] - 1, frames + 2).astype(int)[1:-1])
        share = lambda x, y: float(((x.lo <= y) & (x.hi >= y)).mean())
        at = sorted(at, key=lambda y: -share(left, y) * share(right, y))
        a, b = [np.ascontiguousarray(left.box[:, :, y]) for y in at], [np.ascontiguousarray(right.box[:, :, y]) for y in at]
        there = lambda x, y: (x.lo <= y) & (x.hi >= y)
        a_in, b_in = [there(left, y) for y in at], [there(right, y) for y in at]
        # Compared without a division, so with a little room.
        meets = lambda x, y: (lambda c: c > least * (1 - 1e-9) * (x[4] + y[4] - c))(_intersection(x, y))
        rows = max(1, 4 * CHUNK // len(right.lo))
        for i in range(0, len(left.lo), rows):
            r = slice(i, i + rows)
            keep = meets(a[0][:, r, None], b[0][:, None, :])
            keep |= ~(a_in[0][r, None] & b_in[0][None, :])
            keep &= (left.lo[r, None] <= right.hi[None, :]) & (right.lo[None, :] <= left.hi[r, None])
            ii, jj = np.nonzero(keep)
            ii += i
            if own:
                ii, jj = ii[jj > ii], jj[jj > ii]
            for k in range(1, len(at)):
                ok = meets(a[k][:, ii], b[k][:, jj]) | ~(a_in[k][ii] & b_in[k][jj])
                ii, jj = ii[ok], jj[ok]
            run = max(1, CHUNK // left.box.shape[2])
            for k in range(0, len(ii), run):
                yield ii[k : k + run], jj[k : k + run]

    return pairs


def _bell(width: float, flat: float, apart: np.ndarray) -> tuple[float, np.ndarray]:
    """(period, factors of cos(0), cos(t), cos(2t), ..): a sum of cosines of t = 2 pi distance / period that is
    never negative and nowhere below min(1, (width - |distance|) / flat); of some, the least at `apart`."""
    best = None
    for period in width * np.array([2.2, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0]):
        d = np.linspace(0, width, 2001)
        need = np.minimum(1.0, (width - d) / flat + width / 2000 / flat)  # holds up to the next point as well
        for factors in ([1 / 2, 1 / 2], [3 / 8, 1 / 2, 1 / 8]):
            value = lambda x, c=factors, p=period: sum(f * np.cos(2 * np.pi * x * i / p) for i, f in enumerate(c))
            here = value(d)
            if here.min() <= 0:
                continue
            c = np.array(factors) * 1.001 * (need / np.append(here[1:], here[-1])).max()
            mean = (value(apart) * c[0] / factors[0]).mean() * (1 + 0.2 * (len(factors) - 2))  # terms cost time
            if best is None or mean < best[0]:
                best = (mean, period, c)
    return best[1], best[2]


def _cover_sieve(least: float, samples: int, share: float) -> Callable:
    """Pairs of tracks whose percentile cover may exceed `least`.

    The cover of two boxes is at most a product of two bells of the distances of their middles, each a sum
    of cosines, so that its sum over all frames is a product of matrices. A pair whose sum is below what
    the best `share` of the sampled frames needs is left out; the others are measured."""

    def pairs(left: _Side, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        there = [np.isfinite(x.box[0]) for x in (left, right)]
        sides, frames = (left, right), left.box.shape[2]
        middle, bells = [], []
        draw = np.random.default_rng(0)
        for lo, hi in ((0, 2), (1, 3)):
            size = [(x.box[hi] - x.box[lo])[t] for x, t in zip(sides, there)]
            if not all(len(x) and np.isfinite(x).all() and x.min() > 0 for x in size):
                yield from _all_pairs(left, right, own)
                return
            middle.append([np.where(t, (np.where(t, x.box[lo], 0) + np.where(t, x.box[hi], 0)) / 2, 0) for x, t in zip(sides, there)])
            drawn = [draw.choice(m[t], 4000) for m, t in zip(middle[-1], there)]
            flat = min(x.min() for x in size)
            bells.append(_bell(max((size[0].max() + size[1].max()) / 2, 1e-9), flat, drawn[0] - drawn[1]))

        def terms(side: int, rows: np.ndarray, f: slice) -> np.ndarray:
            """Of each track and frame the factors whose products with the other side's add up to the bells' product."""
            axes = []
            for (period, c), m in zip(bells, middle):
                t = (2 * np.pi / period) * m[side][rows, f]
                trig = [np.full_like(t, c[0] if side else 1.0)]
                for k in range(1, len(c)):
                    trig += [np.cos(k * t) * (c[k] if side else 1.0), np.sin(k * t) * (c[k] if side else 1.0)]
                axes.append(trig)
            whole = np.stack([x * y for x in axes[0] for y in axes[1]], axis=2) * there[side][rows, f, None]
            return whole.astype(np.float32).reshape(len(t), -1)

        reach = [[np.where(t, x.box[lo], np.inf).min(1) for lo in (0, 1)] + [np.where(t, x.box[hi], -np.inf).max(1) for hi in (2, 3)] for x, t in zip(sides, there)]
        order, columns = np.argsort(reach[0][2]), np.argsort(reach[1][0])
        _, _, k = _even(right.lo, right.hi, samples, share, at=False)
        run = max(1, CHUNK // frames)
        for r in np.array_split(order, -(-len(order) // 512)):
            a = [reach[0][i][r].min() for i in (0, 1)] + [reach[0][i][r].max() for i in (2, 3)]
            b = reach[1]
            c = columns[((b[0] < a[2]) & (b[2] > a[0]) & (b[1] < a[3]) & (b[3] > a[1]))[columns]]
            if not len(c):
                continue
            most = np.zeros((len(r), len(c)), np.float32)
            for f in range(0, frames, 32):
                most += terms(0, r, slice(f, f + 32)) @ terms(1, c, slice(f, f + 32)).T
            most *= 1.001
            whole = (left.lo[r, None] <= right.lo[None, c]) & (left.hi[r, None] >= right.hi[None, c])
            ii, jj = np.nonzero((most > (least * k[c]).astype(np.float32)[None, :]) | ~whole)
            bound, ii, jj = most[ii, jj], r[ii], c[jj]
            ok = (left.lo[ii] < right.hi[jj]) & (right.lo[jj] < left.hi[ii]) & ((jj > ii) if own else True)
            bound, ii, jj = bound[ok], ii[ok], jj[ok]
            if len(ii):
                ok = bound > least * _even(np.maximum(left.lo[ii], right.lo[jj]), np.minimum(left.hi[ii], right.hi[jj]), samples, share, at=False)[2]
                ii, jj = ii[ok], jj[ok]
            for i in range(0, len(ii), run):
                yield ii[i : i + run], jj[i : i + run]

    return pairs


def _needed() -> list[Column]:
    """Frames and corners of a track's key boxes in start .. end and of the next ones beyond, from which boxes there are made."""
    inside = (F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end"))
    first = F.greatest(F.lit(1), F.size(F.filter("at", lambda f: f <= F.col("start"))))
    last = F.size("at") + 1 - F.greatest(F.lit(1), F.size(F.filter("at", lambda f: f >= F.col("end"))))
    return [F.when(inside, F.col(c)).otherwise(F.slice(F.col(c), first, last - first + 1)).alias(c) for c in ("at", *CORNERS)]


def _within(a: _Side, i: int | np.ndarray, b: _Side, j: slice | np.ndarray) -> np.ndarray:
    """Whether a track of each pair lies in the other's span."""
    return ((a.lo[i] >= b.lo[j]) & (a.hi[i] <= b.hi[j])) | ((b.lo[j] >= a.lo[i]) & (b.hi[j] <= a.hi[i]))


def _track_pairs(keys: DataFrame, other: DataFrame | None, same: list[str], names: list[str], measure: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], pairs: Callable | None = None, sums: Callable | None = None) -> DataFrame:
    """video_id, a_track, b_track and the doubles `names` of each pair of tracks with frames in common: of
    keys (a < b), or one of keys with one of `other`.

    Blocks of tracks meet where their spans do, each pair of blocks by itself. What travels are the key
    boxes of the frames that the blocks have in common; frames are filled in where the blocks meet, and a
    task holds the frames of two blocks of one video at a time. measure(first, last, within, iou, cover): the
    pairs' common frames as places in the matrices of pairs by frames, which are 0 elsewhere, and whether one
    track lies within the other; gives which pairs stay, and the values of all. pairs(left, right, own): the pairs of two blocks to be measured,
    some at a time. sums(left, right, own), in place of pairs: all that stay, with their values, as far as
    sums tell them: places in left and right, values, and which are still to be measured."""
    by = ["video_id", *same]
    left = _blocks(keys, by, BLOCKS if other is None else BLOCKS_OF_TWO)
    right = left if other is None else _blocks(other, by, BLOCKS_OF_TWO)
    extent = lambda w, n: w.groupBy(*by, F.col("block").alias(f"{n}b")).agg(F.min("lo").alias(f"{n}lo"), F.max("hi").alias(f"{n}hi"))
    met = interval_join(extent(left, "i"), extent(right, "j"), by, ("ilo", "ihi"), ("jlo", "jhi"), 4096)
    met = met.select(*by, "ib", "jb", F.greatest("ilo", "jlo").alias("start"), F.least("ihi", "jhi").alias("end"))
    met = met.where("ib <= jb") if other is None else met
    shape = ["ib", "jb", "start", "end"]
    part = lambda w, n, role: met.join(w.withColumnRenamed("block", n), [*by, n]).where("lo <= end and hi >= start").select(*by, *shape, F.lit(role).alias("role"), "track_id", "lo", "hi", *_needed())
    halves = part(left, "ib", 0)
    both = halves.unionByName(part(right, "jb", 1) if other is not None else part(right, "jb", 1).where("ib <> jb"))
    kinds, alone = dict(both.dtypes), other is None
    out = ", ".join([f"video_id {kinds['video_id']}", f"a_track {kinds['track_id']}", f"b_track {kinds['track_id']}", *[f"{n} double" for n in names]])

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        video, start, end = t.column("video_id")[0], t.column("start")[0].as_py(), t.column("end")[0].as_py()
        own = alone and t.column("ib")[0].as_py() == t.column("jb")[0].as_py()
        role = t.column("role").to_numpy()
        if not (role == 0).any() or not (own or (role == 1).any()):
            return
        a = _Side(t.filter(pa.array(role == 0)), start, end)
        b = a if own else _Side(t.filter(pa.array(role == 1)), start, end)
        ids = [x.ids.to_numpy() for x in (a, b)]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            x, y, v = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            x, y = ids[0][x], ids[1][y]
            if alone:
                x, y = np.minimum(x, y), np.maximum(x, y)
            kind = t.schema.field("track_id").type
            return pa.RecordBatch.from_arrays([pa.repeat(video, len(x)), pa.array(x, kind), pa.array(y, kind), *[pa.array(c) for c in v.T]], ["video_id", "a_track", "b_track", *names])

        def measured(i: int | np.ndarray, j: slice | np.ndarray) -> None:
            lo, hi = np.maximum(a.lo[i], b.lo[j]), np.minimum(a.hi[i], b.hi[j])
            if not (lo <= hi).any():
                return
            f, e = int(lo[lo <= hi].min()), int(hi[lo <= hi].max()) + 1
            x = a.box[:, i : i + 1, f:e] if isinstance(i, int) else a.box[:, i, f:e]
            iou, cover = _overlaps(x, b.box[:, j, f:e])
            within = _within(a, i, b, j)
            if not (lo <= hi).all():
                some = lo <= hi
                iou, cover, lo, hi, within = iou[some], cover[some], lo[some], hi[some], within[some]
                j = np.arange(len(b.lo))[j][some]
                i = i if isinstance(i, int) else i[some]
            stay, values = measure(lo - f, hi - f, within, iou, cover)
            if stay.any():
                held.append((np.broadcast_to(i, stay.shape)[stay], np.arange(len(b.lo))[j][stay], values[stay]))

        run = max(1, CHUNK // a.box.shape[2])
        for found in sums(a, b, own) if sums else (pairs or _all_pairs)(a, b, own):
            i, j = found[:2]
            if sums:
                values, again = found[2:]
                held.append((i[~again], j[~again], values[~again]))
                i, j = i[again], j[again]
                for k in range(0, len(i), run):
                    measured(i[k : k + run], j[k : k + run])
            else:
                measured(i, j)
            if sum(len(h[0]) for h in held) >= 50_000:
                yield batch()
        if held:
            yield batch()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(pa.Table.from_batches(list(batches)))

    return both.groupBy(*by, "ib", "jb").applyInArrow(whole, out)


def pair_metrics(keys: DataFrame, same: list[str], top: float = 0.5, other: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """For pairs of tracks of a video (a < b, or one of keys with one of `other`; of equal `same`) that have
    frames in common: common frames, mean, largest and smallest IoU, mean maxcover, and the mean of the
    largest `top` share of the IoUs. least: only pairs whose smallest IoU is above it."""

    def measure(lo: np.ndarray, hi: np.ndarray, within: np.ndarray, iou: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = hi - lo + 1
        k = np.maximum(1, np.floor(n * top)).astype(int)
        smallest = np.zeros(len(n))
        for r in np.flatnonzero(np.count_nonzero(iou, axis=1) == n):  # else it is 0 somewhere
            smallest[r] = iou[r, lo[r] : hi[r] + 1].min()
        values = np.stack([n, iou.sum(1) / n, iou.max(1), smallest, cover.sum(1) / n, _top(iou, k)], axis=1)
        return np.ones(len(n), bool) if least is None else smallest > least, values

    def sums(left: _Side, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tracks that meet in no more frames than count for the top share need no order of their IoUs."""
        for i, j, (iou, cover, most), meets in _sums(left, right, own):
            n = np.minimum(left.hi[i], right.hi[j]) - np.maximum(left.lo[i], right.lo[j]) + 1
            k = np.maximum(1, np.floor(n * top)).astype(int)
            yield i, j, np.stack([n, iou / n, most, np.zeros(len(n)), cover / n, iou / k], axis=1), (meets > k) | (meets == n)

    every = least is None or least < 0
    p = _track_pairs(keys, other, same, ["frames", "mean_iou", "max_iou", "min_iou", "mean_cover", "top_iou"], measure, None if every else _sieve(least), sums if least is None else None)
    return p.withColumn("frames", F.col("frames").cast("long"))


def segment_metrics(keys: DataFrame, step: int = 5, share: float = 0.8, samples: int = 100, other: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """For pairs of tracks of a video (a < b, or one of keys with one of `other`) whose spans have more than
    one frame in common: over the frames of the common span from its start on, every `step`-th before its
    end: segment_iou and segment_cover (means); over every max(1, length / samples)-th and the last:
    percentile_iou and percentile_cover (means of the best `share`); endpoint_iou (mean at both ends of
    the span); fragment_iou (smallest IoU at every step-th frame where one track lies wholly within the
    other, else 0). least: only pairs whose percentile_cover is above it."""

    def measure(lo: np.ndarray, hi: np.ndarray, within: np.ndarray, iou: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, length = np.arange(len(lo))[:, None], hi - lo
        n = -(-length // step)
        at = np.arange(max(1, n.max()))[None, :]
        out = at >= n[:, None]
        at = row * iou.shape[1] + np.where(out, lo[:, None], lo[:, None] + step * at)
        i, c = iou.take(at), cover.take(at)
        smallest = np.where(within, np.where(out, np.inf, i).min(1), 0.0)
        i[out] = c[out] = 0
        n = np.maximum(n, 1)
        every, m, k = _even(lo, hi, samples, share)
        off = np.arange(every.shape[1])[None, :] >= m[:, None]
        every = row * iou.shape[1] + every
        pi, pc = iou.take(every), cover.take(every)
        pi[off] = pc[off] = 0
        ends = (iou[row[:, 0], lo] + iou[row[:, 0], hi]) / 2
        best = _top(pc, k)
        stay = length > 0 if least is None else (length > 0) & (best > least)
        return stay, np.stack([i.sum(1) / n, c.sum(1) / n, ends, smallest, _top(pi, k), best], axis=1)

    def sums(left: _Side, right: _Side, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of tracks that don't meet in more frames than count for the best share nothing has to be put in order."""
        for i, j, (iou, cover, pi, pc, first, last), (meets, of_samples) in _sampled_sums(left, right, own, step, samples):
            lo, hi = np.maximum(left.lo[i], right.lo[j]), np.minimum(left.hi[i], right.hi[j])
            n, k = -(-(hi - lo) // step), _even(lo, hi, samples, share, at=False)[2]
            again = (of_samples > k) | ((meets == n) & _within(left, i, right, j))
            yield i, j, np.stack([iou / n, cover / n, (first + last) / 2, np.zeros(len(n)), pi / k, pc / k], axis=1), again

    names = ["segment_iou", "segment_cover", "endpoint_iou", "fragment_iou", "percentile_iou", "percentile_cover"]
    return _track_pairs(keys, other, [], names, measure, None if least is None or least < 0 else _cover_sieve(least, samples, share), sums if least is None else None)


def _even(lo: np.ndarray, hi: np.ndarray, samples: int, share: float, at: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Every max(1, length / samples)-th frame from lo on and hi, a row each (hi again where there are
    fewer; left out without `at`), how many they are, and how many of them are the best `share`."""
    dt = np.maximum(1, (hi - lo) // samples)
    m = -(-(hi - lo) // dt) + 1
    every = np.minimum(lo[:, None] + dt[:, None] * np.arange(m.max())[None, :], hi[:, None]) if at else None
    return every, m, np.maximum(1, np.floor(m * share)).astype(int)


def confidence(keys: DataFrame, last: int | None = None, samples: int | None = None) -> DataFrame:
    """Per track: mean confidence of its key boxes, of those in the last frames, or of evenly spaced ones
    from the last back; 0 where none is known."""
    if samples is not None:
        back = Window.partitionBy(*T).orderBy(F.desc("frame"))
        k = keys.withColumn("_r", F.row_number().over(back) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*T)))
        k = k.where(F.pmod("_r", F.greatest(F.lit(1), F.rint(F.col("_n") / samples).cast("int"))) == 0)
    elif last is not None:
        k = keys.withColumn("_e", F.max("frame").over(Window.partitionBy(*T))).where(F.col("frame") >= F.col("_e") - last)
    else:
        k = keys
    return k.groupBy(*T).agg(F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"))


def smooth_shape(keys: DataFrame, width: int, median: bool = False) -> DataFrame:
    """Each key box with the mean (or median) width and height of itself and the following ones, `width`
    in all, about its own middle; a track's last width - 1 boxes are left out."""
    w = _order().rowsBetween(0, width - 1)
    size = lambda f: (F.percentile(f(F.col("box")), 0.5) if median else F.avg(f(F.col("box")))).over(w)
    k = keys.withColumns({"_n": F.count(F.lit(1)).over(w), "_w": size(B.width), "_h": size(B.height)}).where(F.col("_n") == width)
    return k.withColumn("box", B.from_centroid(B.xcentroid(F.col("box")), B.ycentroid(F.col("box")), F.col("_w"), F.col("_h"))).drop("_n", "_w", "_h")


def spline(keys: DataFrame) -> DataFrame:
    """Dense boxes on the smooth curve through the key boxes: cubic pieces whose slope at a key box is
    that between its neighbours (one-sided at the ends), frame by frame from the first to the last."""
    s = spans(keys).withColumn("prev_frame", F.lag("frame").over(_order())).withColumn("prev_box", F.lag("box").over(_order()))
    s = s.withColumn("after_frame", F.lead("frame", 2).over(_order())).withColumn("after_box", F.lead("box", 2).over(_order()))
    at = F.when(F.col("next_frame").isNull(), F.array("frame")).otherwise(F.sequence(F.col("frame"), F.col("next_frame") - 1))
    e = s.withColumn("at", F.explode(at))
    h = (F.col("next_frame") - F.col("frame")).cast("double")
    t = F.try_divide(F.col("at") - F.col("frame"), h)

    def curve(f: str) -> Column:
        p, q = F.col("box")[f], F.col("next_box")[f]
        slope = lambda b, a, fb, fa: F.try_divide(b - a, (fb - fa).cast("double"))
        here = F.coalesce(slope(q, F.col("prev_box")[f], F.col("next_frame"), F.col("prev_frame")), slope(q, p, F.col("next_frame"), F.col("frame")))
        there = F.coalesce(slope(F.col("after_box")[f], p, F.col("after_frame"), F.col("frame")), slope(q, p, F.col("next_frame"), F.col("frame")))
        t2, t3 = t * t, t * t * t
        return F.coalesce((2 * t3 - 3 * t2 + 1) * p + (t3 - 2 * t2 + t) * h * here + (3 * t2 - 2 * t3) * q + (t3 - t2) * h * there, p)

    return e.select(*T, F.col("at").alias("frame"), B.box(*[curve(f) for f in ("xmin", "ymin", "xmax", "ymax")]).alias("box"))


def shape_free_velocity(frames: DataFrame, dt: int) -> DataFrame:
    """For dense frames: mean over the dt frames before of the smaller change of the two sides, by its
    frames, so that a change of the shape is no motion; 0 where the track is not dt frames old."""
    w = _order()

    def v(lo: str, hi: str) -> Column:
        b = F.col("box")
        terms = []
        for k in range(1, dt + 1):
            before = F.lag("box", k).over(w)
            x, y = b[lo] - before[lo], b[hi] - before[hi]
            terms.append(F.when(F.abs(x) <= F.abs(y), x).otherwise(y) / k)
        return F.coalesce(sum(terms[1:], terms[0]) / dt, F.lit(0.0))

    return frames.withColumns({"vx": v("xmin", "xmax"), "vy": v("ymin", "ymax")})


def union(a: DataFrame, b: DataFrame, overlap: str = "average") -> DataFrame:
    """Key boxes of two tracks as one: where both have a frame the mean, or keep a's, or replace by b's."""
    k = ["video_id", "frame"]
    j = a.select(*k, F.col("box").alias("a")).join(b.select(*k, F.col("box").alias("b")), k, "full_outer")
    both = {"average": B.average(F.array("a", "b")), "keep": F.col("a"), "replace": F.col("b")}[overlap]
    return j.select(*k, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).otherwise(F.coalesce("a", "b")).alias("box"))


def truncate(keys: DataFrame, start: int, end: int) -> DataFrame:
    """Key boxes within start .. end, with interpolated ones at the two borders where the track covers them."""
    ends = keys.groupBy(*T).agg(F.min("frame").alias("s"), F.max("frame").alias("e")).where((F.col("s") <= end) & (F.col("e") >= start))
    want = ends.select(*T, F.explode(F.array_distinct(F.array(F.greatest("s", F.lit(start)), F.least("e", F.lit(end))))).alias("at"))
    border = at_frames(keys, want).select(*T, F.col("at").alias("frame"), "box")
    inner = keys.where((F.col("frame") > start) & (F.col("frame") < end)).select(*T, "frame", "box")
    return inner.join(border, [*T, "frame"], "left_anti").unionByName(border)


def clip_to_image(keys: DataFrame, w, h) -> DataFrame:
    return keys.where(B.in_image(F.col("box"), w, h)).withColumn("box", B.clip(F.col("box"), w, h))


def upsert(keys: DataFrame, new: DataFrame) -> DataFrame:
    """Key boxes with those of `new` in place of the ones of the same frame."""
    return keys.join(new, [*T, "frame"], "left_anti").unionByName(new, allowMissingColumns=True)


def delete(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return keys.join(gone, [*T, "frame"], "left_anti")
