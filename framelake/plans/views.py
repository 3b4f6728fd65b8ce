"""Canonical frames over the tables, and the same as SQL for the counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators.collection import Collection
from framelake.operators.detections import to_pixels
from framelake.operators.live import latest
from framelake.sources.tables import table


def objects(spark: SparkSession, d: str, *needs: str) -> DataFrame:
    """Live detections in pixels: image_id, detection_id, category, conf, box (corners in order).

    Normalized boxes are scaled by the size of the live image; where that is unknown the box is null.
    needs: the columns without which an operator has no use for a row (conf, category); else their
    nulls stay."""
    b = B.box(F.least("xmin", "xmax"), F.least("ymin", "ymax"), F.greatest("xmin", "xmax"), F.greatest("ymin", "ymax"))
    cols = {"image_id": F.col("image_id"), "category": F.col("category"), "conf": F.col("conf"), "box": b, "norm": F.coalesce("normalized_coordinates", F.lit(False))}
    live = latest(table(spark, d, "detection"), "detection_id", "ingested_at", cols).where("image_id is not null")
    for c in needs:
        live = live.where(F.col(c).isNotNull())
    size = images(spark, d).select("image_id", "width", "height")
    o = to_pixels(live.join(size, "image_id", "left"), "norm", "width", "height")
    known = ~F.col("norm") | (F.col("width").isNotNull() & F.col("height").isNotNull())
    return o.select("detection_id", "image_id", "category", "conf", F.when(known, F.col("box")).alias("box"))


def images(spark: SparkSession, d: str) -> DataFrame:
    cols = {c: F.col(c) for c in ("filename", "instanceid", "category", "tags", "confidences", "width", "height", "source_name", "release_no")}
    return latest(table(spark, d, "image"), "image_id", "ingested_at", cols)


def keyboxes(spark: SparkSession, d: str) -> DataFrame:
    """Key boxes made of events: a user is a track, an hour a frame."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("int").alias("h"))
    e = e.select("event_id", "user_id", "value", (F.col("h") - 473352).alias("frame"))
    one = e.groupBy("user_id", "frame").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e"))
    b = B.from_xywh(F.col("e.value"), F.pmod("e.event_id", F.lit(100)), 20 + F.pmod("e.event_id", F.lit(7)), F.lit(30))
    conf = F.pmod("e.event_id", F.lit(10)) / 10.0
    return one.select(F.pmod("user_id", F.lit(5)).alias("video_id"), F.col("user_id").alias("track_id"), "frame", b.alias("box"), conf.alias("conf"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Key boxes whose tracks are cut wherever more than three frames lie between two of them."""
    k = keyboxes(spark, d)
    w = Window.partitionBy("track_id").orderBy("frame")
    piece = F.sum(F.when(F.col("frame") - F.lag("frame").over(w) > 3, 1).otherwise(0)).over(w)
    return k.withColumn("track_id", F.col("track_id") * 1000 + piece)


def copied_keyboxes(spark: SparkSession, d: str) -> DataFrame:
    """Key boxes, and those of frames 100 to 300 once more, a little aside, as other tracks."""
    k = keyboxes(spark, d)
    again = k.where("frame between 100 and 300").withColumn("track_id", F.col("track_id") + 100000).withColumn("box", B.translate(F.col("box"), 0.25, 0))
    return k.unionByName(again)


def event_acts(spark: SparkSession, d: str) -> DataFrame:
    """Activities of the tracks of `keyboxes`: purchases and errors last some hours."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    s = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473352).cast("int")
    return e.select(F.pmod("user_id", F.lit(5)).alias("video_id"), F.col("event_id").alias("activity_id"), F.col("event_type").alias("category"), s.alias("startframe"), (s + 6 + F.pmod("event_id", F.lit(12))).cast("int").alias("endframe"), F.array("user_id").alias("track_ids"))


def acts(spark: SparkSession, d: str) -> DataFrame:
    """Live activities with all of video, frames and category, ends in order, in their own rate."""
    cols = {c: F.col(c) for c in ("video_id", "category", "startframe", "endframe", "actor_id", "track_ids", "conf")}
    a = latest(table(spark, d, "activity"), "activity_id", "revision", cols)
    a = a.where("video_id is not null and category is not null and startframe is not null and endframe is not null")
    return a.withColumns({"startframe": F.least("startframe", "endframe"), "endframe": F.greatest("startframe", "endframe")})


def items(spark: SparkSession, d: str) -> Collection:
    """Documents in order of doc_id: doc_id, source, lang, n."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.lower("lang").alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    return Collection.of(docs, ["doc_id"], "documents")


LIVE = "live as (select *, row_number() over (partition by detection_id order by ingested_at desc) as rn from detection)"
OBJ = (
    LIVE
    + """, size_of as (select image_id, width, height from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image) where rn = 1),
px as (select detection_id, l.image_id, l.category, conf, xmin, ymin, xmax, ymax, case when coalesce(normalized_coordinates, false) then s.width + 0 * s.height else 1 end as kx, case when coalesce(normalized_coordinates, false) then s.height + 0 * s.width else 1 end as ky
 from live l left join size_of s on s.image_id = l.image_id where rn = 1 and l.image_id is not null),
obj as (select detection_id, image_id, category, conf, case when kx is not null then least(xmin, xmax) * kx end as x1, case when ky is not null then least(ymin, ymax) * ky end as y1, case when kx is not null then greatest(xmin, xmax) * kx end as x2, case when ky is not null then greatest(ymin, ymax) * ky end as y2 from px),
ob as (select *, x2 - x1 as w, y2 - y1 as h, (x2 - x1) * (y2 - y1) as area from obj),
bx as (select * from ob where x1 is not null)"""
)
IMG = "img as (select * from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image) where rn = 1)"
KEY = """ev as (select event_id, user_id, value, event_type, cast(floor(epoch(ts) / 3600) as int) - 473352 as frame from events),
kb as (select user_id % 5 as video_id, user_id as track_id, frame, value as x1, (event_id % 100)::double as y1, value + 20 + event_id % 7 as x2, (event_id % 100 + 30)::double as y2, (event_id % 10) / 10.0::double as conf
 from (select *, row_number() over (partition by user_id, frame order by event_id) as rn from ev) where rn = 1)"""
FRAG = "fg as (select video_id, track_id * 1000 + sum(case when g > 3 then 1 else 0 end) over (partition by track_id order by frame rows unbounded preceding) as track_id, frame, x1, y1, x2, y2 from (select *, frame - lag(frame) over (partition by track_id order by frame) as g from kb))"
COPY = "ck as (select video_id, track_id, frame, x1, y1, x2, y2, conf from kb union all select video_id, track_id + 100000, frame, x1 + 0.25, y1, x2 + 0.25, y2, conf from kb where frame between 100 and 300)"
EACT = "ea as (select user_id % 5 as video_id, event_id as activity_id, event_type as category, frame as startframe, cast(frame + 6 + event_id % 12 as int) as endframe, user_id as track_id from ev where event_type in ('purchase', 'error'))"
ACT = """act as (select activity_id, video_id, category, least(startframe, endframe) as startframe, greatest(startframe, endframe) as endframe, actor_id, track_ids, conf
 from (select *, row_number() over (partition by activity_id order by revision desc) as rn from activity) where rn = 1 and video_id is not null and category is not null and startframe is not null and endframe is not null)"""
ITEM = "it as (select row_number() over (order by doc_id) - 1 as p, doc_id, source, lower(lang) as lang, coalesce(n_chars, 0) as n, count(*) over () as total from documents)"
