"""Activities: spans of frames with a category, an actor and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.joins import interval_join


def length(s: Column, e: Column) -> Column:
    return F.greatest(e - s, F.lit(0))


def temporal_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    u = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((inter > 0) & (u > 0), inter.cast("double") / u).otherwise(0.0)


def has_overlap(s1: Column, e1: Column, s2: Column, e2: Column, threshold: float = 0) -> Column:
    iou = temporal_iou(s1, e1, s2, e2)
    return iou > threshold


def is_neighbor(s1: Column, e1: Column, s2: Column, e2: Column, gate: int = 10) -> Column:
    return temporal_iou(s1, e1, s2 - gate, e2 + gate) > 0


def temporal_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1 - e2, s2 - e1, F.lit(0))


def during(s: Column, e: Column, f: Column) -> Column:
    return (f >= s) & (f <= e)


def during_interval(s: Column, e: Column, f1: Column, f2: Column, inclusive: bool = False) -> Column:
    return (s <= f2 + (1 if inclusive else 0)) & (e >= f1)


def middle(s: Column, e: Column) -> Column:
    return F.rint(length(s, e) / 2).cast("int") + s


def pad_to(s: Column, e: Column, frames: int) -> tuple[Column, Column]:
    """Span of at least `frames` frames about the same middle."""
    pad = F.greatest(F.ceil((F.lit(frames) - length(s, e)) / 2), F.lit(0)).cast("int")
    return s - pad, e + pad


def truncate(s: Column, e: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    a, b = F.greatest(s, lo), F.least(e, hi)
    return a, F.greatest(a, b)


def pairs(acts: DataFrame, key: str, ident: str, by: list[str] | None = None, bucket: int = 256) -> DataFrame:
    """Pairs of activities of a video (smaller ident first) that overlap, with their temporal IoU."""
    side = acts.select(key, ident, *(by or []), "startframe", "endframe")
    j = interval_join(side, side, [key, *(by or [])], ("startframe", "endframe"), ("startframe", "endframe"), bucket, closed=False)
    j = j.where(F.col(ident) < F.col(f"{ident}_2"))
    return j.withColumn("tiou", temporal_iou(F.col("startframe"), F.col("endframe"), F.col("startframe_2"), F.col("endframe_2")))


def at_frames(frames: DataFrame, acts: DataFrame, key: str, frame: str, bucket: int = 256) -> DataFrame:
    """Rows of frames beside the activities they lie in (both ends count)."""
    f = frames.withColumn("_f", F.col(frame))
    return interval_join(f, acts, [key], (frame, "_f"), ("startframe", "endframe"), bucket).drop("_f")


def clips(acts: DataFrame, frames: DataFrame, key: str, ident: str, order: str, pad: int = 0) -> DataFrame:
    """One clip an activity of positive length, in order of start: padded, cut to the video, and the
    activity's frames counted from the clip's start. frames: key, n_frames."""
    j = acts.where(F.col("endframe") > F.col("startframe")).join(frames, key)
    a, b = F.greatest(F.col("startframe") - pad, F.lit(0)), F.least(F.col("endframe") + pad, F.col("n_frames"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("startframe", order)) - 1
    j = j.withColumns({"clip_start": a, "clip_end": b, "clip": place})
    return j.where("clip_end > clip_start").withColumns({"rel_start": F.greatest(F.col("startframe") - F.col("clip_start"), F.lit(0)), "rel_end": F.least(F.col("endframe"), F.col("clip_end")) - F.col("clip_start")})


def secondary(clip: DataFrame, acts: DataFrame, key: str, ident: str, tracks: str, bucket: int = 256) -> DataFrame:
    """Other activities that overlap a clip and share a track with its own."""
    j = interval_join(clip, acts, [key], ("clip_start", "clip_end"), ("startframe", "endframe"), bucket, closed=False)
    return j.where((F.col(ident) != F.col(f"{ident}_2")) & F.arrays_overlap(tracks, f"{tracks}_2"))


def merge_confidence(a: Column, b: Column, weight: float = 0.5, largest: bool = False) -> Column:
    return F.greatest(a, b) if largest else a * weight + b * (1 - weight)


def neighbours_in_order(acts: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """Next and previous activity by insertion order, first by start, last by end, within a video."""
    w = Window.partitionBy(key).orderBy(order)
    return acts.withColumns({"next_id": F.lead(ident).over(w), "prev_id": F.lag(ident).over(w)})


def filter_tracks(acts: DataFrame, keep: DataFrame, key: str, tracks: str, track: str) -> DataFrame:
    """Track lists cut to the tracks that `keep` has for the video (empty where none is left)."""
    k = keep.groupBy(key).agg(F.collect_set(track).alias("_k"))
    return acts.join(k, key, "left").withColumn(tracks, F.array_intersect(F.col(tracks), F.coalesce("_k", F.array().cast("array<bigint>")))).drop("_k")
