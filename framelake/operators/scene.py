"""Video scenes: tracks and activities of a video together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators import activities as A
from framelake.operators import tracks as K
from framelake.operators.intervals import periods_and_gaps
from framelake.operators.joins import interval_join
from framelake.session import cut

T = K.T


def frame_objects(frames: DataFrame, acts: DataFrame, bucket: int = 256) -> DataFrame:
    """Every track box of every frame with the sorted categories of the activities whose tracks hold it."""
    links = acts.select("video_id", "category", "startframe", "endframe", F.explode("track_ids").alias("track_id"))
    hit = interval_join(frames.select(*T, "frame").withColumn("_f", F.col("frame")), links, T, ("frame", "_f"), ("startframe", "endframe"), bucket)
    cats = hit.groupBy(*T, "frame").agg(F.array_sort(F.collect_set("category")).alias("activities"))
    return frames.join(cats, [*T, "frame"], "left").withColumn("activities", F.coalesce("activities", F.array().cast("array<string>")))


def labels(frames: DataFrame, acts: DataFrame, bucket: int = 256) -> DataFrame:
    """Per (video, frame) the sorted distinct categories of its activities; frames without any have none."""
    hit = A.at_frames(frames.select("video_id", "frame").distinct(), acts.select("video_id", "category", "startframe", "endframe"), "video_id", "frame", bucket)
    return hit.groupBy("video_id", "frame").agg(F.array_sort(F.collect_set("category")).alias("labels"))


def without_activity(extent: DataFrame, acts: DataFrame) -> DataFrame:
    """Maximal spans [start, end) of each video's extent (video_id, startframe, endframe) without activity."""
    edge = lambda c, d: extent.select("video_id", F.col(c).alias("startframe"), (F.col(c) + d).alias("endframe"))
    inside = acts.join(extent.select("video_id", F.col("startframe").alias("lo"), F.col("endframe").alias("hi")), "video_id")
    a, b = F.greatest("startframe", "lo"), F.least(F.col("endframe") + 1, F.col("hi"))
    spans = inside.select("video_id", a.alias("startframe"), b.alias("endframe"))
    # Empty marks just outside the extent turn the outer spans into gaps as well.
    marks = edge("startframe", 0).withColumn("startframe", F.col("startframe") - 1).unionByName(edge("endframe", 1))
    gaps = periods_and_gaps(spans.unionByName(marks), ["video_id"], "startframe", "endframe").where("kind = 'gap'")
    return gaps.select("video_id", "startframe", "endframe")


def split_by_track(keys: DataFrame, acts: DataFrame) -> DataFrame:
    """One scene a track, with the number of the activities that hold it."""
    links = acts.select("video_id", F.explode("track_ids").alias("track_id"), "activity_id")
    n = links.groupBy(*T).agg(F.count_distinct("activity_id").alias("activities"))
    s = keys.groupBy(*T).agg(F.min("frame").alias("startframe"), F.max("frame").alias("endframe"))
    return s.join(n, T, "left").withColumn("activities", F.coalesce("activities", F.lit(0)))


def merge_candidates(keys: DataFrame, frames_apart: int = 5, dilate: float = 2.0, bucket: int = 16) -> DataFrame:
    """Tracks whose last box, dilated, meets the first box of exactly one track that starts within
    frames_apart frames after.

    Ends meet the starts of their bucket of frames; an end that has met two is looked at no further, so
    that crowded frames cost no more than the tracks in them."""
    g = keys.groupBy(*T).agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.min_by("box", "frame").alias("first"), F.max_by("box", "frame").alias("last"))
    corners = lambda b: [b[c].alias(c) for c in K.CORNERS]
    ends = g.select(*T, F.col("e").alias("frame"), *corners(B.dilate(F.col("last"), dilate)), F.floor(F.col("e") / bucket).alias("_b"), F.lit(False).alias("starts"))
    before = F.sequence(F.floor((F.col("s") - frames_apart) / bucket), F.floor((F.col("s") - 1) / bucket))
    starts = g.select(*T, F.col("s").alias("frame"), *corners(F.col("first")), F.explode(before).alias("_b"), F.lit(True).alias("starts"))

    rows = ends.unionByName(starts).dropna(subset=list(K.CORNERS))

    def meet(t: pa.Table) -> pa.Table:
        role = t.column("starts").to_numpy()
        side = [t.filter(pa.array(role == x)) for x in (False, True)]
        (e, s), ids = [x.column("frame").to_numpy() for x in side], [x.column("track_id").to_numpy() for x in side]
        a, b = [np.stack([x.column(c).to_numpy() for c in K.CORNERS]) for x in side]
        nexts, n = np.zeros(len(e), np.int64), np.zeros(len(e), int)
        by_end, by_start = np.argsort(e, kind="stable"), np.argsort(s, kind="stable")
        for frame in np.unique(e):
            rows = by_end[np.searchsorted(e[by_end], frame) : np.searchsorted(e[by_end], frame, "right")]
            near = by_start[np.searchsorted(s[by_start], frame, "right") : np.searchsorted(s[by_start], frame + frames_apart, "right")]
            n[rows], nexts[rows] = _meets_once(a[:, rows], ids[0][rows], b[:, near], ids[1][near])
        one = np.flatnonzero(n == 1)
        return side[0].select(T).take(pa.array(one)).append_column("next_track", pa.array(nexts[one], side[0].schema.field("track_id").type))

    kinds = dict(g.dtypes)
    found = rows.groupBy("video_id", "_b").applyInArrow(meet, f"video_id {kinds['video_id']}, track_id {kinds['track_id']}, next_track {kinds['track_id']}")
    return found.select(*T, "next_track")


def _meets_once(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each box of a (corners first): how many boxes of b of another id it overlaps, as far as two, and the
    first one's id."""
    n, first = np.zeros(len(own), int), np.zeros(len(own), np.int64)
    if not len(ids):
        return n, first
    order = np.argsort(b[0])
    b, ids = b[:, order], ids[order]
    at = np.searchsorted(b[0], a[0] - (b[2] - b[0]).max())
    end = np.searchsorted(b[0], a[2])
    left, run = np.flatnonzero(at < end), 32
    while len(left):
        for part in np.array_split(left, -(-len(left) * run // 500_000)):
            k = at[part, None] + np.arange(run)[None, :]
            inside = k < end[part, None]
            k = np.minimum(k, len(ids) - 1)
            hit = inside & (b[2][k] > a[0][part, None]) & (b[1][k] < a[3][part, None]) & (b[3][k] > a[1][part, None]) & (ids[k] != own[part, None])
            new = hit.any(1) & (n[part] == 0)
            first[part[new]] = ids[k[new, hit[new].argmax(1)]]
            n[part] += hit.sum(1)
        at[left] += run
        left, run = left[(n[left] < 2) & (at[left] < end[left])], min(2 * run, 1024)
    return n, first


def duplicate_tracks(pairs: DataFrame, lengths: DataFrame, threshold: float = 0.8) -> DataFrame:
    """From pair metrics: shorter tracks that lie wholly within a longer one in time and whose smallest
    IoU with it exceeds the threshold, with the longest such track."""
    a = lengths.select("video_id", F.col("track_id").alias("a_track"), F.col("startframe").alias("as"), F.col("endframe").alias("ae"))
    b = lengths.select("video_id", F.col("track_id").alias("b_track"), F.col("startframe").alias("bs"), F.col("endframe").alias("be"))
    j = pairs.where(F.col("min_iou") > threshold).join(a, ["video_id", "a_track"]).join(b, ["video_id", "b_track"])
    la, lb = F.col("ae") - F.col("as"), F.col("be") - F.col("bs")
    a_in = (F.col("as") >= F.col("bs")) & (F.col("ae") <= F.col("be")) & (la <= lb)
    b_in = (F.col("bs") >= F.col("as")) & (F.col("be") <= F.col("ae")) & ~a_in
    rows = j.select("video_id", F.when(a_in, F.col("a_track")).when(b_in, F.col("b_track")).alias("track_id"), F.when(a_in, F.col("b_track")).otherwise(F.col("a_track")).alias("into"), F.greatest(la, lb).alias("n"))
    return rows.where("track_id is not null").groupBy(*T).agg(F.max_by("into", F.struct("n", "into")).alias("into"))


def rekey(rows: DataFrame, mapping: DataFrame, col: str = "track_id") -> DataFrame:
    """Ids rewritten by a table (video_id, old, new)."""
    m = mapping.select("video_id", F.col("old").alias(col), F.col("new").alias("_new"))
    out = rows.join(m, ["video_id", col], "left").withColumn(col, F.coalesce("_new", col))
    return out.select(*rows.columns)


def clip(keys: DataFrame, acts: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Tracks and activities within [start, end], counted from start; activities left without length go."""
    t = K.truncate(keys, start, end).withColumn("frame", F.col("frame") - start)
    a, b = A.truncate(F.col("startframe"), F.col("endframe"), F.lit(start), F.lit(end))
    acts = acts.withColumns({"startframe": a - start, "endframe": b - start}).where("endframe > startframe")
    return t, acts


def reframe_activities(acts: DataFrame, factor) -> DataFrame:
    f = lambda c: F.rint(F.col(c) * factor).cast("int")
    return acts.withColumns({"startframe": f("startframe"), "endframe": f("endframe")})


def concatenate(videos: DataFrame, order: str, group: list[str]) -> DataFrame:
    """Offset of every video in the concatenation of its group: frames of those before."""
    w = Window.partitionBy(*group).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return videos.withColumn("offset", F.coalesce(F.sum("n_frames").over(before), F.lit(0))).withColumn("place", F.row_number().over(w) - 1)


def sample_frames(videos: DataFrame, n: int) -> DataFrame:
    """n evenly strided frames of every video (stride: n_frames / n, half to even, at least one)."""
    stride = F.greatest(F.rint(F.col("n_frames") / n).cast("int"), F.lit(1))
    f = videos.where("n_frames > 0").withColumn("stride", stride).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return f.withColumn("frame", F.col("k") * F.col("stride")).where("frame < n_frames")


def tensor_frames(videos: DataFrame, start: int, length: int, stride: int = 1, boundary: str = "repeat") -> DataFrame:
    """Frames of a fixed-length slice; beyond the end the last one again (repeat) or from the start (cyclic)."""
    k = F.explode(F.sequence(F.lit(start), F.lit(start + length - 1), F.lit(stride))).alias("at")
    f = videos.where("n_frames > 0").select("video_id", "n_frames", k)
    frame = F.least(F.col("at"), F.col("n_frames") - 1) if boundary == "repeat" else F.pmod(F.col("at"), F.col("n_frames"))
    return f.withColumn("frame", frame)


def flatten(frames: DataFrame, acts: DataFrame) -> DataFrame:
    """The export form: one row a frame and object, activities joined by ';'."""
    o = frame_objects(frames, acts)
    b = F.col("box")
    return o.select("video_id", "frame", "track_id", b["xmin"].alias("xmin"), b["ymin"].alias("ymin"), B.width(b).alias("width"), B.height(b).alias("height"), F.array_join("activities", ";").alias("activities"))


def union(a: DataFrame, a_acts: DataFrame, b: DataFrame, b_acts: DataFrame, cover: float = 0.6, temporal: float = 0.5, share: float = 0.8, samples: int = 100, overlap: str = "average") -> tuple[DataFrame, DataFrame]:
    """(key boxes, activities) of two scenes of the same videos: tracks of b (video_id, track_id, category,
    frame, box) that lie on one of a become part of it, activities of b that a has already are left out.

    A track of b is merged into the longest track of a (ties: smaller id) of its category whose best
    `share` of covers over the common span has a mean above `cover`; where both have a key box, they are
    averaged, or a's is kept, or b's replaces it. An activity of b (video_id, activity_id, category,
    startframe, endframe, track_ids) falls if one of a has its category, the same tracks after merging
    and a temporal IoU above `temporal`. Ids of a and b must differ (`rekey`)."""
    category = lambda k, n: k.groupBy(*T).agg(F.first("category", ignorenulls=True).alias("c"), (F.max("frame") - F.min("frame")).alias("len")).select("video_id", F.col("track_id").alias(f"{n}_track"), F.col("c").alias(f"{n}_c"), F.col("len").alias(f"{n}_len"))
    m = K.segment_metrics(a, share=share, samples=samples, other=b, least=cover).where(F.col("percentile_cover") > cover)
    m = m.join(category(a, "a"), ["video_id", "a_track"]).join(category(b, "b"), ["video_id", "b_track"]).where(F.col("a_c").eqNullSafe(F.col("b_c")))
    into = cut(m.groupBy("video_id", F.col("b_track").alias("track_id")).agg(F.max_by("a_track", F.struct("a_len", -F.col("a_track"))).alias("into")))

    cols = [*T, "category", "frame", "box"]
    moved = b.select(*cols).join(into, T, "left").withColumn("own", F.coalesce("into", "track_id"))
    both = a.select(*cols, F.lit(0).alias("side")).unionByName(moved.select("video_id", F.col("own").alias("track_id"), "category", "frame", "box", F.lit(1).alias("side")))
    mean = B.mean_agg(F.col("box"))
    box = {"average": mean, "keep": F.min_by("box", "side"), "replace": F.max_by("box", "side")}[overlap]
    keys = both.groupBy(*T, "frame").agg(F.min_by("category", "side").alias("category"), box.alias("box"))

    named = lambda acts: acts.select("video_id", "activity_id", "category", "startframe", "endframe", F.array_sort(F.array_distinct("track_ids")).alias("track_ids"))
    link = b_acts.select("video_id", "activity_id", F.explode("track_ids").alias("track_id")).join(into, T, "left")
    link = link.groupBy("video_id", "activity_id").agg(F.array_sort(F.collect_set(F.coalesce("into", "track_id"))).alias("track_ids"))
    new = b_acts.drop("track_ids").join(link, ["video_id", "activity_id"]).select("video_id", "activity_id", "category", "startframe", "endframe", "track_ids")
    old = named(a_acts)
    o = old.select("video_id", "category", "track_ids", F.col("startframe").alias("s"), F.col("endframe").alias("e"))
    inter = F.least("endframe", "e") - F.greatest("startframe", "s")
    seen = new.join(o, ["video_id", "category", "track_ids"]).where((inter > 0) & (inter > temporal * (F.greatest("endframe", "e") - F.least("startframe", "s")))).select("video_id", "activity_id").distinct()
    return keys, old.unionByName(new.join(seen, ["video_id", "activity_id"], "left_anti"))
