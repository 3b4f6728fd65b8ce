"""Queries of tracks, activities, video scenes, metrics, texts, grids and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions import numeric as N
from framelake.functions import pixels as X
from framelake.functions import strings as S
from framelake.functions import tags as G
from framelake.operators import activities as A
from framelake.operators import matrix as M
from framelake.operators import metrics as R
from framelake.operators import scene as C
from framelake.operators import tracks as K
from framelake.operators.joins import block_join, interval_join, nearest
from framelake.plans.views import ACT, COPY, EACT, FRAG, IMG, KEY, OBJ, acts, copied_keyboxes, event_acts, fragments, images, keyboxes, objects
from framelake.sources.tables import table
from framelake.streaming import tracker, windows

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def r(c, name: str, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n).alias(name)


W = f"with {KEY} "
SP = W + ", sp as (select *, lead(frame) over t as nf, lead(x1) over t as nx1, lead(y1) over t as ny1, lead(x2) over t as nx2, lead(y2) over t as ny2 from kb window t as (partition by track_id order by frame)) "
#: Boxes for every frame.
DENSE = SP + """, dn as (select video_id, track_id, f as frame, x1 + (coalesce(nx1, x1) - x1) * t as x1, y1 + (coalesce(ny1, y1) - y1) * t as y1, x2 + (coalesce(nx2, x2) - x2) * t as x2, y2 + (coalesce(ny2, y2) - y2) * t as y2
 from (select *, case when nf is null then 0 else (f - frame) / (nf - frame)::double end as t from (select *, unnest(range(frame, coalesce(nf, frame + 1))) as f from sp))) """


def fixed(c, name: str):
    """Millionths on a scale whose borders are no short binary fractions: the order of additions doesn't matter."""
    return (F.floor((F.col(c) if isinstance(c, str) else c) * 1000000 + 0.4999) / 1000000).alias(name)


def fixed_sql(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.4999) / 1000000"


@q("track_interpolate", DENSE + f"select track_id, frame, {fixed_sql('x1')} as xmin, {fixed_sql('y1')} as ymin, {fixed_sql('x2')} as xmax from dn")
def track_interpolate(spark, d):
    f = K.dense(keyboxes(spark, d))
    return f.select("track_id", "frame", fixed("box.xmin", "xmin"), fixed("box.ymin", "ymin"), fixed("box.xmax", "xmax"))


@q("track_resample", DENSE + ", e as (select track_id, min(frame) as s, max(frame) as e from kb group by 1) select d.track_id, d.frame, " + fixed_sql("d.x1") + " as xmin from dn d join e using (track_id) where (d.frame - e.s) % 5 = 0 or d.frame = e.e")
def track_resample(spark, d):
    f = K.dense(keyboxes(spark, d), 5)
    return f.select("track_id", "frame", fixed("box.xmin", "xmin"))


@q("track_at_frames", DENSE + ", w as (select distinct track_id, a from kb, (select unnest([100, 250, 5000]) as a)) select w.track_id, w.a as at, round(d.x1, 6) as xmin from w left join dn d on d.track_id = w.track_id and d.frame = w.a")
def track_at_frames(spark, d):
    k = keyboxes(spark, d)
    want = k.select(*K.T).distinct().select(*K.T, F.explode(F.array(*[F.lit(x) for x in (100, 250, 5000)])).alias("at"))
    return K.at_frames(k, want).select("track_id", "at", r("box.xmin", "xmin"))


@q("track_reframe", W + "select track_id, cast(round_even(frame * 0.4, 0) as int) as frame, count(*) > 0 as any_box from kb group by 1, 2")
def track_reframe(spark, d):
    return K.reframe(keyboxes(spark, d), 0.4).select("track_id", "frame", F.col("box").isNotNull().alias("any_box"))


@q("track_stats", W + """, s as (select *, x1 + (x2 - x1) / 2 as xc, y1 + (y2 - y1) / 2 as yc from kb), t as (select *, coalesce(sqrt((xc - lag(xc) over w) ** 2 + (yc - lag(yc) over w) ** 2), 0) as step from s window w as (partition by track_id order by frame))
select track_id, min(frame) as startframe, max(frame) as endframe, count(*) as keyframes, max(frame) - min(frame) + 1 as length, round((max(frame) - min(frame) + 1) / 30.0, 6) as duration, round(sum(step), 4) as pathlength, round(avg(x1), 6) as mean_xmin, round(avg(x2 - x1), 6) as mean_width, round(var_pop(x2 - x1), 6) as var_width, round(min((x2 - x1) * (y2 - y1)), 4) as smallest_area,
 round(avg(conf), 6) as confidence, round(sqrt((arg_max(xc, frame) - arg_min(xc, frame)) ** 2 + (arg_max(yc, frame) - arg_min(yc, frame)) ** 2), 6) as closure from t group by track_id""")
def track_stats(spark, d):
    s = K.stats(keyboxes(spark, d))
    return s.select("track_id", "startframe", "endframe", "keyframes", "length", r("duration", "duration"), r("pathlength", "pathlength", 4), r("meanbox.xmin", "mean_xmin"), r("mean_width", "mean_width"), r("var_width", "var_width"), r("smallest_area", "smallest_area", 4), r("confidence", "confidence"), r("closure", "closure"))


@q("track_smooth", W + ", s as (select track_id, frame, (sum(x1) over w + x1) / 4 as xmin, count(*) over w as n from kb window w as (partition by track_id order by frame rows between current row and 2 following)) select track_id, frame, round(xmin, 6) as xmin from s where n = 3")
def track_smooth(spark, d):
    return K.smooth(keyboxes(spark, d), 3).select("track_id", "frame", r("box.xmin", "xmin"))


#: Centres of all frames; before a track's first frame its first box stands once more (bf), as tracks cover that frame.
_CENTRE = DENSE + """, c as (select video_id, track_id, frame, x1 + (x2 - x1) / 2 as xc, y1 + (y2 - y1) / 2 as yc from dn),
bf as (select * from c union all select video_id, track_id, frame - 1, xc, yc from (select *, row_number() over (partition by track_id order by frame) as rn from c) where rn = 1),
v as (select a.video_id, a.track_id, a.frame, coalesce(avg((a.xc - b.xc) / (a.frame - b.frame)), 0) as vx, coalesce(avg((a.yc - b.yc) / (a.frame - b.frame)), 0) as vy from c a left join bf b on b.track_id = a.track_id and b.frame < a.frame and b.frame >= a.frame - 4 group by 1, 2, 3) """


@q("track_velocity", _CENTRE + f"select track_id, frame, {fixed_sql('vx')} as vx, {fixed_sql('vy')} as vy from v")
def track_velocity(spark, d):
    v = K.velocity(K.dense(keyboxes(spark, d)), 5)
    return v.select("track_id", "frame", fixed("vx", "vx"), fixed("vy", "vy"))


@q("track_bearing_change", _CENTRE + ", bg as (select video_id, track_id, frame, atan2(vy, vx) as be from v where vx <> 0 or vy <> 0), ch as (select *, coalesce(be - lag(be) over (partition by track_id order by frame), 0) as d from bg), s as (select track_id, sum(d) as s from ch group by 1) select track_id, floor(case when abs(s) <= pi() then s when s > 0 then 2 * pi() - s else 2 * pi() + s end * 10000 + 0.4999) / 10000 as bearing_change from s")
def track_bearing(spark, d):
    return K.bearing_change(K.dense(keyboxes(spark, d)), 5).select("track_id", (F.floor(F.col("bearing_change") * 10000 + 0.4999) / 10000).alias("bearing_change"))


@q("track_acceleration", _CENTRE + ", w as (select *, lead(vx, 10) over o - lag(vx, 5) over o as dx, lead(vy, 10) over o - lag(vy, 5) over o as dy from v window o as (partition by track_id order by frame)) select track_id, frame, floor(sqrt((dx / 10) ** 2 + (dy / 10) ** 2) * 10000 + 0.4999) / 10000 as acceleration from w where dx is not null")
def track_acceleration(spark, d):
    return K.acceleration(K.dense(keyboxes(spark, d)), 5).select("track_id", "frame", (F.floor(F.col("acceleration") * 10000 + 0.4999) / 10000).alias("acceleration")).where("acceleration is not null")


@q("track_extrapolate", W + ", l as (select *, row_number() over (partition by track_id order by frame desc) as rn from kb), p as (select a.track_id, a.frame as fa, b.frame as fb, a.x1 as ax, (a.x1 + a.x2) / 2 as ac, (b.x1 + b.x2) / 2 as bc from l a join l b on a.track_id = b.track_id and a.rn = 1 and b.rn = 2) select track_id, fa + 5 as frame, round(ax + (ac - bc) / (fa - fb) * 5, 6) as xmin from p")
def track_extrapolate(spark, d):
    return K.extrapolate(keyboxes(spark, d), 5).select("track_id", "frame", r("box.xmin", "xmin"))


@q("track_truncate", DENSE + ", e as (select track_id, min(frame) as s, max(frame) as e from kb group by 1), w as (select track_id, greatest(s, 100) as a, least(e, 200) as b from e where s <= 200 and e >= 100) select distinct d.track_id, d.frame, round(d.x1, 6) as xmin from dn d join w on w.track_id = d.track_id and (d.frame = w.a or d.frame = w.b or (d.frame > 100 and d.frame < 200 and exists (select 1 from kb where kb.track_id = d.track_id and kb.frame = d.frame)))")
def track_truncate(spark, d):
    return K.truncate(keyboxes(spark, d), 100, 200).select("track_id", "frame", r("box.xmin", "xmin"))


@q("nearest_keyframe_asof", W + ", w as (select distinct track_id, a from kb, (select unnest([50, 111, 365, 700]) as a)), n as (select w.track_id, w.a, k.frame, row_number() over (partition by w.track_id, w.a order by abs(k.frame - w.a), k.frame) as rn from w join kb k on k.track_id = w.track_id) select track_id, a as at, frame as nearest from n where rn = 1")
def nearest_keyframe(spark, d):
    k = keyboxes(spark, d)
    want = k.select("track_id").distinct().select("track_id", F.explode(F.array(*[F.lit(x) for x in (50, 111, 365, 700)])).alias("at"))
    return nearest(want, k.withColumn("nearest", F.col("frame")), ["track_id"], "at", "frame", ["nearest"])


_IOU = "case when least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1) then (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) else 0 end"


#: Pairs of tracks over all common frames.
_PM = """j as (select a.video_id, a.track_id as a_track, b.track_id as b_track, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ba, """ + _IOU + """ as i from dn a join dn b on a.video_id = b.video_id and a.frame = b.frame and a.track_id < b.track_id),
k as (select *, i / (aa + ba - i) as iou, greatest(i / aa, i / ba) as cv from j), n as (select *, row_number() over (partition by a_track, b_track order by iou desc) as rk, count(*) over (partition by a_track, b_track) as nn from k),
pm as (select video_id, a_track, b_track, count(*) as frames, avg(iou) as mean_iou, max(iou) as max_iou, min(iou) as min_iou, avg(cv) as mean_cover, avg(iou) filter (where rk <= greatest(1, floor(nn * 0.5))) as top_iou from n group by 1, 2, 3) """


@q("track_pair_iou", DENSE + ", " + _PM + "select video_id, a_track, b_track, frames, " + ", ".join(f"{fixed_sql(c)} as {c}" for c in ("mean_iou", "max_iou", "min_iou", "mean_cover", "top_iou")) + " from pm")
def track_pair_iou(spark, d):
    p = K.pair_metrics(keyboxes(spark, d), [])
    return p.select("video_id", "a_track", "b_track", "frames", *[fixed(c, c) for c in ("mean_iou", "max_iou", "min_iou", "mean_cover", "top_iou")])


_SEG = DENSE + f""", ex as (select video_id, track_id, min(frame) as lo, max(frame) as hi from dn group by 1, 2),
sp2 as (select a.video_id, a.track_id as a_track, b.track_id as b_track, greatest(a.lo, b.lo) as s, least(a.hi, b.hi) as e, (a.lo >= b.lo and a.hi <= b.hi) or (b.lo >= a.lo and b.hi <= a.hi) as within from ex a join ex b on a.video_id = b.video_id and a.track_id < b.track_id where least(a.hi, b.hi) > greatest(a.lo, b.lo)),
fr as (select p.*, a.frame as f, greatest(1, (p.e - p.s) // 100) as dt, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ba, {_IOU} as i from sp2 p join dn a on a.video_id = p.video_id and a.track_id = p.a_track and a.frame between p.s and p.e join dn b on b.video_id = p.video_id and b.track_id = p.b_track and b.frame = a.frame),
m as (select *, i / (aa + ba - i) as iou, greatest(i / aa, i / ba) as cv, (f - s) % 5 = 0 and f < e as st, (f - s) % dt = 0 or f = e as ev from fr),
r1 as (select *, row_number() over (partition by a_track, b_track, ev order by iou desc) as ri, row_number() over (partition by a_track, b_track, ev order by cv desc) as rc, count(*) filter (where ev) over (partition by a_track, b_track) as ne from m)
select video_id, a_track, b_track, {fixed_sql('avg(iou) filter (where st)')} as segment_iou, {fixed_sql('avg(cv) filter (where st)')} as segment_cover, {fixed_sql('avg(iou) filter (where f = s or f = e)')} as endpoint_iou, {fixed_sql('case when any_value(within) then min(iou) filter (where st) else 0 end')} as fragment_iou,
 {fixed_sql('avg(iou) filter (where ev and ri <= greatest(1, floor(ne * 0.8)))')} as percentile_iou, {fixed_sql('avg(cv) filter (where ev and rc <= greatest(1, floor(ne * 0.8)))')} as percentile_cover from r1 group by 1, 2, 3"""


@q("track_segment_metrics", _SEG)
def track_segments(spark, d):
    m = K.segment_metrics(keyboxes(spark, d))
    return m.select("video_id", "a_track", "b_track", *[fixed(c, c) for c in ("segment_iou", "segment_cover", "endpoint_iou", "fragment_iou", "percentile_iou", "percentile_cover")])


@q("track_confidence_samples", W + ", n as (select track_id, frame, conf, row_number() over (partition by track_id order by frame desc) - 1 as r, count(*) over (partition by track_id) as n, max(frame) over (partition by track_id) as e from kb) select track_id, round(avg(conf) filter (where r % greatest(1, round_even(n / 4.0, 0)::int) = 0), 6) as sampled, round(avg(conf) filter (where frame >= e - 100), 6) as last100 from n group by 1")
def track_confidences(spark, d):
    k = keyboxes(spark, d)
    a, b = K.confidence(k, samples=4), K.confidence(k, last=100)
    return a.select(*K.T, r("confidence", "sampled")).join(b.select(*K.T, r("confidence", "last100")), K.T).drop("video_id")


@q("track_smooth_shape", W + ", s as (select track_id, frame, (x1 + x2) / 2 as xc, avg(x2 - x1) over w as aw, quantile_cont(x2 - x1, 0.5) over w as mw, count(*) over w as n from kb window w as (partition by track_id order by frame rows between current row and 2 following)) select track_id, frame, round(xc - aw / 2, 5) as mean_xmin, round(xc - mw / 2, 5) as median_xmin from s where n = 3")
def track_smooth_shape(spark, d):
    k = keyboxes(spark, d)
    a, b = K.smooth_shape(k, 3), K.smooth_shape(k, 3, median=True)
    return a.select(*K.T, "frame", r("box.xmin", "mean_xmin", 5)).join(b.select(*K.T, "frame", r("box.xmin", "median_xmin", 5)), [*K.T, "frame"]).drop("video_id")


@q("track_spline", W + f""", n as (select track_id, frame, x1, lag(frame) over o as pf, lag(x1) over o as px, lead(frame) over o as nf, lead(x1) over o as nx, lead(frame, 2) over o as af, lead(x1, 2) over o as ax from kb window o as (partition by track_id order by frame)),
m as (select *, coalesce((nx - px) / (nf - pf)::double, (nx - x1) / (nf - frame)::double) as m0, coalesce((ax - x1) / (af - frame)::double, (nx - x1) / (nf - frame)::double) as m1, (nf - frame)::double as h from n),
e as (select *, unnest(range(frame, coalesce(nf, frame + 1))) as f from m), t as (select *, (f - frame) / h as t from e)
select track_id, f as frame, {fixed_sql('coalesce((2*t*t*t - 3*t*t + 1) * x1 + (t*t*t - 2*t*t + t) * h * m0 + (3*t*t - 2*t*t*t) * nx + (t*t*t - t*t) * h * m1, x1)')} as xmin from t""")
def track_spline(spark, d):
    return K.spline(keyboxes(spark, d)).select("track_id", "frame", fixed("box.xmin", "xmin"))


@q("track_shape_free_velocity", DENSE + f", p as (select a.track_id, a.frame, a.frame - b.frame as k, case when abs(a.x1 - b.x1) <= abs(a.x2 - b.x2) then a.x1 - b.x1 else a.x2 - b.x2 end as dx from dn a left join dn b on b.track_id = a.track_id and b.frame < a.frame and b.frame >= a.frame - 4) select track_id, frame, {fixed_sql('case when count(k) = 4 then sum(dx / k) / 4 else 0 end')} as vx from p group by 1, 2")
def track_shape_free(spark, d):
    return K.shape_free_velocity(K.dense(keyboxes(spark, d)), 4).select("track_id", "frame", fixed("vx", "vx"))


@q("track_union_average", W + ", a as (select * from kb where track_id // 5 % 2 = 0), b as (select * from kb where track_id // 5 % 2 = 1), p as (select video_id, frame, avg(x1) as x from (select video_id, frame, avg(x1) as x1 from a group by 1, 2 union all select video_id, frame, avg(x1) from b group by 1, 2) group by 1, 2) select video_id, frame, round(x, 6) as xmin from p")
def track_union(spark, d):
    """The tracks of even number of every video, averaged, with those of odd number."""
    k = keyboxes(spark, d)
    mean = lambda n: k.where(F.pmod(F.floor(F.col("track_id") / 5), F.lit(2)) == n).groupBy("video_id", "frame").agg(B.mean_agg(F.col("box")).alias("box"))
    return K.union(mean(0), mean(1)).select("video_id", "frame", r("box.xmin", "xmin"))


@q("track_clip_image", W + "select track_id, frame, round(least(x2, 60), 6) as xmax from kb where x1 < 60 and x2 > 0 and y1 < 80 and y2 > 0")
def track_clip_image(spark, d):
    return K.clip_to_image(keyboxes(spark, d), 60, 80).select("track_id", "frame", r("box.xmax", "xmax"))


@q("activity_temporal_iou", f"with {ACT} select a.activity_id as a_id, b.activity_id as b_id, round((least(a.endframe, b.endframe) - greatest(a.startframe, b.startframe)) / (greatest(a.endframe, b.endframe) - least(a.startframe, b.startframe))::double, 6) as tiou from act a join act b on a.video_id = b.video_id and a.activity_id < b.activity_id and least(a.endframe, b.endframe) > greatest(a.startframe, b.startframe)")
def activity_temporal_iou(spark, d):
    p = A.pairs(acts(spark, d), "video_id", "activity_id")
    return p.select(F.col("activity_id").alias("a_id"), F.col("activity_id_2").alias("b_id"), r("tiou", "tiou"))


@q("activity_measures", f"with {ACT} select activity_id, greatest(endframe - startframe, 0) as length, cast(round_even((endframe - startframe) / 2.0, 0) as int) + startframe as middle, (startframe <= 100 and endframe >= 100) as at_100, (startframe <= 300 and endframe >= 100) as in_span, startframe - cast(greatest(ceil((60 - (endframe - startframe)) / 2.0), 0) as int) as pad_start from act")
def activity_measures(spark, d):
    s, e = F.col("startframe"), F.col("endframe")
    return acts(spark, d).select("activity_id", A.length(s, e).alias("length"), A.middle(s, e).alias("middle"), A.during(s, e, F.lit(100)).alias("at_100"), A.during_interval(s, e, F.lit(100), F.lit(300)).alias("in_span"), A.pad_to(s, e, 60)[0].alias("pad_start"))


@q("activity_next_previous", f"with {ACT} select activity_id, lead(activity_id) over w as next_id, lag(activity_id) over w as prev_id from act window w as (partition by video_id order by activity_id)")
def activity_next(spark, d):
    return A.neighbours_in_order(acts(spark, d), "video_id", "activity_id", "activity_id").select("activity_id", "next_id", "prev_id")


_CLIP = f"with {ACT}, cl as (select a.activity_id, a.video_id, a.startframe, a.endframe, v.n_frames, greatest(a.startframe - 5, 0) as cs, least(a.endframe + 5, v.n_frames) as ce, row_number() over (partition by a.video_id order by a.startframe, a.activity_id) - 1 as clip from act a join video v on v.video_id = a.video_id where a.endframe > a.startframe) "


@q("activityclip_rebased", _CLIP + "select video_id, activity_id, clip, cs as clip_start, ce as clip_end, greatest(startframe - cs, 0) as rel_start, least(endframe, ce) - cs as rel_end from cl where ce > cs")
def activityclip(spark, d):
    v = table(spark, d, "video").select("video_id", "n_frames")
    return A.clips(acts(spark, d), v, "video_id", "activity_id", "activity_id", 5).select("video_id", "activity_id", "clip", "clip_start", "clip_end", "rel_start", "rel_end")


@q("frame_labels", f"with {KEY}, {EACT} select k.video_id, k.frame, list_sort(list(distinct e.category)) as labels from (select distinct video_id, frame from kb) k join ea e on e.video_id = k.video_id and k.frame between e.startframe and e.endframe group by 1, 2")
def frame_labels(spark, d):
    return C.labels(keyboxes(spark, d), event_acts(spark, d), 24)


@q("frame_objects_with_activities", f"with {KEY}, {EACT}, h as (select k.track_id, k.frame, list_sort(list(distinct e.category)) as a from kb k join ea e on e.track_id = k.track_id and k.frame between e.startframe and e.endframe group by 1, 2) select k.track_id, k.frame, coalesce(array_to_string(h.a, ';'), '') as activities from kb k left join h using (track_id, frame)")
def frame_objects(spark, d):
    return C.frame_objects(keyboxes(spark, d), event_acts(spark, d), 24).select("track_id", "frame", F.array_join("activities", ";").alias("activities"))


@q("scene_flat_export", f"with {KEY}, {EACT}, h as (select k.track_id, k.frame, list_sort(list(distinct e.category)) as a from kb k join ea e on e.track_id = k.track_id and k.frame between e.startframe and e.endframe group by 1, 2) select k.video_id, k.frame, k.track_id, k.x1 as xmin, k.y1 as ymin, round(k.x2 - k.x1, 6) as width, round(k.y2 - k.y1, 6) as height, coalesce(array_to_string(h.a, ';'), '') as activities from kb k left join h using (track_id, frame)")
def scene_flat(spark, d):
    f = C.flatten(keyboxes(spark, d), event_acts(spark, d))
    return f.withColumns({"width": F.round("width", 6), "height": F.round("height", 6)})


@q("noactivity_gaps")
def noactivity(spark, d):
    v = table(spark, d, "video").select("video_id", F.lit(0).alias("startframe"), F.col("n_frames").alias("endframe")).where("endframe > 0")
    return C.without_activity(v, acts(spark, d))


O["noactivity_gaps"] = f"""with {ACT}, fr as (select video_id, unnest(range(n_frames)) as f from video where n_frames > 0),
fx as (select fr.video_id, fr.f from fr where not exists (select 1 from act a where a.video_id = fr.video_id and fr.f >= a.startframe and fr.f <= a.endframe)),
g as (select video_id, f, f - row_number() over (partition by video_id order by f) as k from fx)
select video_id, cast(min(f) as int) as startframe, cast(max(f) + 1 as int) as endframe from g group by video_id, k"""


@q("scene_clip_activities", f"with {ACT} select activity_id, greatest(startframe, 100) - 100 as startframe, least(endframe, 400) - 100 as endframe from act where least(endframe, 400) > greatest(startframe, 100)")
def scene_clip(spark, d):
    return C.clip(keyboxes(spark, d), acts(spark, d), 100, 400)[1].select("activity_id", "startframe", "endframe")


@q("merge_tracks_candidates", f"""with {KEY}, {FRAG}, g as (select video_id, track_id, min(frame) as s, max(frame) as e, arg_min(x1, frame) as fx1, arg_min(y1, frame) as fy1, arg_min(x2, frame) as fx2, arg_min(y2, frame) as fy2, arg_max(x1, frame) as lx1, arg_max(y1, frame) as ly1, arg_max(x2, frame) as lx2, arg_max(y2, frame) as ly2 from fg group by 1, 2),
l as (select video_id, track_id, e, (lx1 + lx2) / 2 - (lx2 - lx1) as x1, (lx1 + lx2) / 2 + (lx2 - lx1) as x2, (ly1 + ly2) / 2 - (ly2 - ly1) as y1, (ly1 + ly2) / 2 + (ly2 - ly1) as y2 from g),
j as (select l.video_id, l.track_id, n.track_id as next_track from l join g n on n.video_id = l.video_id and n.track_id <> l.track_id and n.s > l.e and n.s <= l.e + 5 and least(l.x2, n.fx2) > greatest(l.x1, n.fx1) and least(l.y2, n.fy2) > greatest(l.y1, n.fy1))
select video_id, track_id, min(next_track) as next_track from j group by 1, 2 having count(*) = 1""")
def merge_tracks(spark, d):
    return C.merge_candidates(fragments(spark, d), 5)


_CDENSE = DENSE.replace("from kb window", "from ck window").replace(KEY, f"{KEY}, {COPY}")


def dedupe_sql(least: float) -> str:
    return _CDENSE + ", " + _PM + f", ex as (select video_id, track_id, min(frame) as s, max(frame) as e from ck group by 1, 2), q as (select pm.video_id, a_track, b_track, a.s as as_, a.e as ae, b.s as bs, b.e as be from pm join ex a on a.track_id = a_track join ex b on b.track_id = b_track where min_iou > {least}), z as (select video_id, case when as_ >= bs and ae <= be and ae - as_ <= be - bs then a_track when bs >= as_ and be <= ae then b_track end as track_id, case when as_ >= bs and ae <= be and ae - as_ <= be - bs then b_track else a_track end as into_, greatest(ae - as_, be - bs) as n from q) select video_id, track_id, arg_max(into_, (n, into_)) as \"into\" from z where track_id is not null group by 1, 2"


def duplicates(spark, d, least: float):
    k = copied_keyboxes(spark, d)
    return C.duplicate_tracks(K.pair_metrics(k, [], least=least), K.stats(k).select(*K.T, "startframe", "endframe"), least)


@q("scene_dedupe_candidates", dedupe_sql(0.0))
def scene_dedupe(spark, d):
    return duplicates(spark, d, 0.0)


@q("scene_duplicates", dedupe_sql(0.8))
def scene_duplicates(spark, d):
    return duplicates(spark, d, 0.8)


_UCOPY = COPY.replace("where frame between 100 and 300)", "where frame between 100 and 300 union all select video_id, track_id + 200000, frame, x1 + 500, y1, x2 + 500, y2, conf from kb where frame between 100 and 300)")
_UNION = DENSE.replace("from kb window", "from ck window").replace(KEY, f"{KEY}, {EACT}, {_UCOPY}") + f""", ex as (select video_id, track_id, min(frame) as lo, max(frame) as hi from ck group by 1, 2),
sp2 as (select a.video_id, a.track_id as a_track, b.track_id as b_track, greatest(a.lo, b.lo) as s, least(a.hi, b.hi) as e, a.hi - a.lo as len from ex a join ex b on a.video_id = b.video_id and a.track_id < 100000 and b.track_id >= 100000 where least(a.hi, b.hi) > greatest(a.lo, b.lo)),
fr as (select p.*, a.frame as f, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ba, {_IOU} as i from sp2 p join dn a on a.video_id = p.video_id and a.track_id = p.a_track and a.frame between p.s and p.e and ((a.frame - p.s) % greatest(1, (p.e - p.s) // 100) = 0 or a.frame = p.e) join dn b on b.video_id = p.video_id and b.track_id = p.b_track and b.frame = a.frame),
m as (select *, greatest(i / aa, i / ba) as cv from fr), rk as (select *, row_number() over (partition by a_track, b_track order by cv desc) as r, count(*) over (partition by a_track, b_track) as n from m),
pc as (select video_id, a_track, b_track, any_value(len) as len, avg(cv) filter (where r <= greatest(1, floor(n * 0.8))) as pc from rk group by 1, 2, 3),
into_ as (select video_id, b_track as track_id, arg_max(a_track, (len, -a_track)) as into_track from pc where pc > 0.6 group by 1, 2) """


def two_scenes(spark, d):
    """Key boxes and activities; and those of frames 100 to 300 once more as other tracks: a little aside
    (even tracks' activities) and far away (odd tracks'), a frame later."""
    k = keyboxes(spark, d).withColumn("category", F.lit("any"))
    part = k.where("frame between 100 and 300")
    move = lambda by, dx: part.withColumn("track_id", F.col("track_id") + by).withColumn("box", B.translate(F.col("box"), dx, 0))
    a = event_acts(spark, d)
    t = F.get("track_ids", F.lit(0))
    b = a.withColumns({"activity_id": F.col("activity_id") + 1000000, "startframe": F.col("startframe") + 1, "endframe": F.col("endframe") + 1, "track_ids": F.array(t + F.when(t % 2 == 0, 100000).otherwise(200000))})
    return k, a, move(100000, 0.25).unionByName(move(200000, 500)), b


@q("scene_union_tracks", _UNION + f"select c.video_id, coalesce(into_track, c.track_id) as track_id, frame, {fixed_sql('avg(x1)')} as xmin from ck c left join into_ i on i.video_id = c.video_id and i.track_id = c.track_id group by 1, 2, 3")
def scene_union_tracks(spark, d):
    return C.union(*two_scenes(spark, d))[0].select("video_id", "track_id", "frame", fixed("box.xmin", "xmin"))


@q("scene_union_activities", _UNION + ", b as (select video_id, activity_id + 1000000 as activity_id, category, startframe + 1 as startframe, endframe + 1 as endframe, case when track_id % 2 = 0 then track_id + 100000 else track_id + 200000 end as track_id from ea), bm as (select b.* exclude (track_id), coalesce(i.into_track, b.track_id) as track_id from b left join into_ i on i.video_id = b.video_id and i.track_id = b.track_id) select video_id, activity_id, track_id from ea union all select video_id, activity_id, track_id from bm where not exists (select 1 from ea where ea.video_id = bm.video_id and ea.category = bm.category and ea.track_id = bm.track_id and least(ea.endframe, bm.endframe) > greatest(ea.startframe, bm.startframe) and (least(ea.endframe, bm.endframe) - greatest(ea.startframe, bm.startframe)) > 0.5 * (greatest(ea.endframe, bm.endframe) - least(ea.startframe, bm.startframe)))")
def scene_union_activities(spark, d):
    return C.union(*two_scenes(spark, d))[1].select("video_id", "activity_id", F.get("track_ids", F.lit(0)).alias("track_id"))


@q("split_by_track", f"with {KEY}, {EACT} select k.track_id, min(k.frame) as startframe, max(k.frame) as endframe, coalesce((select count(distinct activity_id) from ea where ea.track_id = k.track_id), 0) as activities from kb k group by k.track_id")
def split_by_track(spark, d):
    return C.split_by_track(keyboxes(spark, d), event_acts(spark, d)).select("track_id", "startframe", "endframe", "activities")


@q("concatenate_videos", "select video_id, coalesce(sum(n_frames) over (partition by fps order by video_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", row_number() over (partition by fps order by video_id) - 1 as place from video")
def concatenate(spark, d):
    return C.concatenate(table(spark, d, "video"), "video_id", ["fps"]).select("video_id", "offset", "place")


@q("sample_frames", "select video_id, k * stride as frame from (select video_id, n_frames, greatest(cast(round_even(n_frames / 9.0, 0) as int), 1) as stride from video where n_frames > 0), range(9) t(k) where k * stride < n_frames")
def sample_frames(spark, d):
    return C.sample_frames(table(spark, d, "video"), 9).select("video_id", "frame")


@q("tensor_frames_cyclic", "select video_id, a as \"at\", a % n_frames as frame from video, range(0, 2000, 250) t(a) where n_frames > 0")
def tensor_frames(spark, d):
    return C.tensor_frames(table(spark, d, "video"), 0, 1751, 250, "cyclic").select("video_id", F.col("at").cast("long").alias("at"), "frame")


@q("actor_activity_density", f"with {ACT} select category, count(*) as n, count(distinct video_id) as videos, round(avg(endframe - startframe), 6) as mean_length from act group by category")
def density(spark, d):
    return acts(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("videos"), F.round(F.avg(F.col("endframe") - F.col("startframe")), 6).alias("mean_length"))


# --- metrics, matrices, numbers ------------------------------------------------------------------

_SC = "with e as (select vec_id, label, embedding from embeddings), sc as (select p.vec_id as probe, g.vec_id as gallery, floor(list_dot_product(p.embedding::double[], g.embedding::double[]) * 1000000 + 0.5) / 1000000 as score, (p.label = g.label)::int as match from e p join e g on p.vec_id % 50 = 0 and g.vec_id <> p.vec_id) "


def scores(spark, d):
    """Every fiftieth vector against all: blocks of the probe set meet the gallery."""
    e = table(spark, d, "embeddings")
    p = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("probe"), F.col("embedding").alias("pe"), F.col("label").alias("pl"))
    j = block_join(p, e).where(F.col("vec_id") != F.col("probe"))
    return j.select("probe", F.col("vec_id").alias("gallery"), (F.floor(N.dot(F.col("pe"), F.col("embedding")) * 1000000 + 0.5) / 1000000).alias("score"), (F.col("pl") == F.col("label")).cast("int").alias("match"))


@q("cmc_curve", _SC + ", rk as (select probe, match, row_number() over (partition by probe order by score desc, gallery) as r from sc), b as (select probe, min(r) as r from rk where match = 1 group by probe), c as (select r, count(*) as n from b group by r) select r as rank, round(sum(n) over (order by r) / (select count(*) from b)::double, 6) as recall from c")
def cmc(spark, d):
    return R.cumulative_match(scores(spark, d), "probe", "gallery", "score", "match").select(F.col("rank").cast("long").alias("rank"), r("recall", "recall"))


_ROC = _SC + ", bb as (select floor(score * 10000 + 0.5) / 10000 as t, count(*) filter (where match = 1) as p, count(*) filter (where match <> 1) as n from sc group by 1), cv as (select t, sum(n) over (order by t desc) / (select sum(n) from bb)::double as fpr, sum(p) over (order by t desc) / (select sum(p) from bb)::double as tpr from bb) "


@q("roc_curve", _ROC + "select t as threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from cv")
def roc_curve(spark, d):
    return R.roc(scores(spark, d), "score", "match").select("threshold", r("fpr", "fpr"), r("tpr", "tpr"))


@q("tpr_at_fpr", _ROC + ", lo as (select fpr, tpr from cv where fpr <= 0.1 order by fpr desc, tpr desc limit 1), hi as (select fpr as f2, tpr as t2 from cv where fpr >= 0.1 order by fpr, tpr limit 1) select round(tpr + (t2 - tpr) * case when f2 = fpr then 0 else (0.1 - fpr) / (f2 - fpr) end, 6) as tpr from lo, hi")
def tpr_at_fpr(spark, d):
    return R.tpr_at_fpr(scores(spark, d), "score", "match", 0.1).select(r("tpr", "tpr"))


@q("average_precision_by_category", f"with {OBJ}, x as (select category, floor(conf * 10000 + 0.5) / 10000 as t, count(*) filter (where image_id % 3 = 0) as p, count(*) as k from ob where category is not null and conf is not null group by 1, 2), c as (select *, sum(p) over w as cp, sum(k) over w as ck, sum(p) over (partition by category) as pp from x window w as (partition by category order by t desc rows unbounded preceding)) select category, round(coalesce(sum(case when pp > 0 then cp / ck::double * p / pp end), 0), 6) as ap from c group by category")
def average_precision(spark, d):
    o = objects(spark, d, "category", "conf").withColumn("truth", (F.pmod("image_id", F.lit(3)) == 0).cast("int"))
    return R.average_precision(o, "category", "conf", "truth").select("category", r("ap", "ap"))


@q("confusion_counts", f"with {OBJ}, {IMG} select i.category as truth, o.category as predicted, count(*) as n from ob o join img i using (image_id) where i.category is not null and o.category is not null group by 1, 2")
def confusion(spark, d):
    i = images(spark, d).select("image_id", F.col("category").alias("truth")).where("truth is not null")
    j = objects(spark, d, "category").select("image_id", F.col("category").alias("predicted")).join(i, "image_id")
    return R.confusion(j, "truth", "predicted")


@q("confidence_histogram", f"with {OBJ} select cast(case when conf < 0 then 0 when conf >= 1 then 21 else floor(conf * 20) + 1 end as bigint) as bin, count(*) as n from ob where conf is not null group by 1")
def conf_histogram(spark, d):
    return R.histogram(objects(spark, d, "conf"), "conf", 0.0, 1.0, 20)


@q("ascii_bars", f"with {OBJ} select detection_id, repeat('█', cast(round_even(40 * least(greatest(conf, 0), 1), 0) as int)) as bar from ob where conf is not null")
def bars(spark, d):
    return objects(spark, d, "conf").select("detection_id", R.bar(F.col("conf")).alias("bar"))


def counts(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    seg = F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1
    segs = c.select("c_mktsegment").distinct().withColumn("j", seg)
    return c.join(F.broadcast(segs), "c_mktsegment").groupBy(F.col("c_nationkey").alias("i"), "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


_M = "with s as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as j from (select distinct c_mktsegment from customer)), m as (select c_nationkey as i, j, count(*)::double as v from customer join s using (c_mktsegment) group by 1, 2) "


@q("row_stochastic", _M + "select i, j, round(v / sum(v) over (partition by i), 6) as v from m")
def row_stochastic(spark, d):
    return M.row_stochastic(counts(spark, d)).select("i", "j", r("v", "v"))


@q("row_normalized", _M + "select i, j, round(v / sqrt(sum(v * v) over (partition by i)), 6) as v from m")
def row_normalized(spark, d):
    return M.row_normalized(counts(spark, d)).select("i", "j", r("v", "v"))


_SINK = _M + "".join(f", r{k} as (select i, j, v / (sum(v) over (partition by i) + 1e-16) as v from {'m' if k == 0 else f'c{k - 1}'}), c{k} as (select i, j, v / (sum(v) over (partition by j) + 1e-16) as v from r{k})" for k in range(10))


@q("sinkhorn_10", _SINK + " select i, j, round(v, 6) as v from c9")
def sinkhorn(spark, d):
    return M.bistochastic(counts(spark, d), 10).select("i", "j", r("v", "v"))


@q("matrix_argmax", _M + "select i, j, v from m order by v desc, i, j limit 1")
def matrix_argmax(spark, d):
    return M.arg_max(counts(spark, d))


@q("runningmean", W + "select track_id, frame, round(m, 6) as mean from (select *, avg(x1) over w as m, count(*) over w as n from kb window w as (partition by track_id order by frame rows between 4 preceding and current row)) where n = 5")
def runningmean(spark, d):
    k = keyboxes(spark, d).select("track_id", "frame", F.col("box.xmin").alias("x"))
    return M.running_mean(k, ["track_id"], "frame", "x", 5).select("track_id", "frame", r("mean", "mean"))


@q("softmax_arrays", "with e as (select vec_id, [x::double / 0.5 for x in embedding] as a from embeddings), m as (select vec_id, [exp(x - list_max(a)) for x in a] as z from e) select vec_id, round(z[1] / list_sum(z), 6) as first, round(list_max(z) / list_sum(z), 6) as largest from m")
def softmax(spark, d):
    s = N.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.5)
    return table(spark, d, "embeddings").select("vec_id", s.alias("s")).select("vec_id", r(F.get("s", F.lit(0)), "first"), r(F.array_max("s"), "largest"))


@q("number_helpers", "select p_partkey, floor(p_retailprice * 10 + 0.0) is not null as ok, p_size % 2 = 0 as even, pow(2, floor(log2(p_size))) as p2, round(sign(p_retailprice - 1000) * sqrt(abs(p_retailprice - 1000)), 6) as root, round(sqrt(p_size * p_size + 9.0), 6) as radius from part")
def number_helpers(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select("p_partkey", N.decimals(F.col("p_retailprice"), 1).isNotNull().alias("ok"), N.is_even(size).alias("even"), N.power_of_two(size).alias("p2"), r(N.signed_root(F.col("p_retailprice") - 1000), "root"), r(N.to_polar(size, F.lit(3.0))["r"], "radius"))


# --- texts, tags, attributes ---------------------------------------------------------------------


@q("path_parts", f"""with {IMG} select image_id, regexp_extract(filename, '([^/\\\\]*)$', 1) as tail, regexp_replace(filename, '[/\\\\]?[^/\\\\]*$', '') as folder, regexp_extract(regexp_extract(filename, '([^/\\\\]*)$', 1), '^[^.]+((?:\\.[^.]+)+)$', 1) as ext,
 regexp_replace(regexp_extract(filename, '([^/\\\\]*)$', 1), '^([^.]+)(?:\\.[^.]+)+$', '\\1') as base, coalesce(regexp_matches(lower(filename), '\\.(jpg|jpeg|png|tif|tiff|pgm|ppm|gif|bmp|webp)$'), false) as is_image from img""")
def path_parts(spark, d):
    f = "filename"
    return images(spark, d).select("image_id", S.file_tail(f).alias("tail"), S.file_path(f).alias("folder"), S.file_ext(f).alias("ext"), S.file_base(f).alias("base"), S.is_image(f).alias("is_image"))


@q("count_by_folder", f"with {IMG} select regexp_extract(regexp_replace(filename, '[/\\\\]?[^/\\\\]*$', ''), '([^/\\\\]*)$', 1) as folder, count(*) as n from img group by 1")
def by_folder(spark, d):
    return images(spark, d).groupBy(S.parent("filename").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@q("url_predicates", "with u as (select doc_id, unnest(string_split(text, ' ')) as w from documents where text is not null) select coalesce(regexp_matches(lower(w), '^(https?|ftp|s3|scp|rtsp|rtmp)://[^/\\s]+'), false) as is_url, coalesce(regexp_matches(w, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\z'), false) as is_email, try_cast(w as double) is not null as is_number, count(*) as n from u where regexp_matches(w, '^[A-Za-z0-9.:/@_%+-]+\\z') and not regexp_matches(lower(w), '^[+-]?(nan|inf|infinity)\\z|[0-9_.][dfe_]\\z|_') group by 1, 2, 3")
def url_predicates(spark, d):
    u = table(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", " ")).alias("w"))
    u = u.where(F.col("w").rlike(r"^[A-Za-z0-9.:/@_%+-]+\z") & ~F.lower("w").rlike(r"^[+-]?(nan|inf|infinity)\z|[0-9_.][dfe_]\z|_"))
    return u.groupBy(S.is_url("w").alias("is_url"), S.is_email("w").alias("is_email"), S.is_number("w").alias("is_number")).agg(F.count(F.lit(1)).alias("n"))


@q("sha_prefix", "select doc_id, substr(sha256(text), 1, 16) as h from documents where text is not null")
def sha_prefix(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.string_hash("text").alias("h"))


@q("text_shortened", "select doc_id, case when length(text) > 40 then left(text, 40) || '...' else text end as short, lpad((coalesce(n_chars, 0) // 60)::varchar, greatest(2, length((coalesce(n_chars, 0) // 60)::varchar))::int, '0') || ':' || lpad((coalesce(n_chars, 0) % 60)::varchar, 2, '0') as clock from documents where text is not null")
def text_shortened(spark, d):
    n = F.coalesce("n_chars", F.lit(0))
    m = F.floor(n / 60).cast("string")
    clock = F.concat(F.lpad(m, F.greatest(F.lit(2), F.length(m)), F.lit("0")), F.lit(":"), F.lpad(F.pmod(n, F.lit(60)).cast("string"), F.lit(2), F.lit("0")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.truncated("text", 40).alias("short"), clock.alias("clock"))


@q("attribute_json", "select event_id, (props->>'k')::bigint as k, json_valid(props) as ok from events")
def attribute_json(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("ok"))


@q("soft_tags", f"with {IMG}, t as (select image_id, confidences, unnest(list_distinct(tags)) as tag from img), c as (select image_id, tag, confidences[tag] as conf from t) select image_id, count(*) as n, max(conf) as best, arg_max(tag, (conf, tag)) as tag from c where conf is not null group by image_id")
def soft_tags(spark, d):
    i = images(spark, d).select("image_id", G.soft_tags(F.col("tags"), F.col("confidences")).alias("s")).where(F.size("s") > 0)
    return i.select("image_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["conf"].alias("best"), F.get("s", F.lit(0))["tag"].alias("tag"))


@q("tag_algebra", f"with {IMG} select image_id, tags[1] as category, coalesce(list_contains(tags, 'outdoor'), false) as outdoor, len(list_distinct(list_concat(coalesce(tags, []), ['checked']))) as n from img")
def tag_algebra(spark, d):
    t = F.col("tags")
    return images(spark, d).select("image_id", G.category(t).alias("category"), G.has_tag(t, "outdoor").alias("outdoor"), F.size(G.add_tags(t, F.array(F.lit("checked")))).cast("long").alias("n"))


# --- grids ---------------------------------------------------------------------------------------


def thumbs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), X.from_flat(F.col("embedding"), 8, 8).alias("g"))


_G = "with g as (select vec_id as id, [x::double for x in embedding] as a from embeddings) "


@q("grid_stats", _G + "select id, round(list_min(a), 6) as lo, round(list_max(a), 6) as hi, round(list_avg(a), 6) as mean, round(list_sum(a), 5) as total from g")
def grid_stats(spark, d):
    g = F.col("g")
    return thumbs(spark, d).select("id", r(X.minimum(g), "lo"), r(X.maximum(g), "hi"), r(X.mean(g), "mean"), r(X.total(g), "total", 5))


@q("grid_flip_rotate", _G + "select id, round(a[8], 6) as lr, round(a[57], 6) as ud, round(a[57], 6) as cw, round(a[8], 6) as ccw, round(a[19], 6) as crop from g")
def grid_flip(spark, d):
    g = F.col("g")
    first = lambda x: F.get(F.get(x, F.lit(0)), F.lit(0))
    return thumbs(spark, d).select("id", r(first(X.fliplr(g)), "lr"), r(first(X.flipud(g)), "ud"), r(first(X.rot90cw(g)), "cw"), r(first(X.rot90ccw(g)), "ccw"), r(first(X.crop(g, 2, 2, 4, 4)), "crop"))


@q("grid_intensity", _G + "select id, round((a[10] - list_min(a)) / (list_max(a) - list_min(a)), 6) as gray, round(a[10] * 2 + 1, 6) as scaled, round(least(greatest(a[10], -0.1), 0.1), 6) as cut from g")
def grid_intensity(spark, d):
    g = F.col("g")
    at = lambda x: F.get(F.get(x, F.lit(1)), F.lit(1))
    return thumbs(spark, d).select("id", r(at(X.to_gray(g)), "gray"), r(at(X.normalize(g, 2, 1)), "scaled"), r(at(X.saturate(g, -0.1, 0.1)), "cut"))


_BITS = "case when a[least(y + 1, 7) * 8 + x + 1] > a[greatest(y - 1, 0) * 8 + x + 1] then '1' else '0' end || case when a[y * 8 + least(x + 1, 7) + 1] > a[y * 8 + greatest(x - 1, 0) + 1] then '1' else '0' end"
_H = _G + f", c as (select id, y * 7 + x as k, {_BITS} as b from g, range(7) t(y), range(7) s(x)), h as (select id, string_agg(b, '' order by k) as bits from c group by id) "


@q("dhash_bits", _H + "select id, bits from h")
def dhash_bits(spark, d):
    return thumbs(spark, d).select("id", X.dhash(F.col("g"), 7).alias("bits"))


@q("hamming_pairs", _H + ", w as (select id, [('0b' || lpad(substr(bits, k * 32 + 1, 32), 32, '0'))::varchar for k in range(4)] as s, bits from h), p as (select a.id as key_a, b.id as key_b, bit_count(xor(a.bits::bit, b.bits::bit)) as distance from h a join h b on a.id < b.id) select key_a, key_b, distance from p where distance < 29")
def hamming_pairs(spark, d):
    return X.hamming_pairs(thumbs(spark, d).select("id", X.dhash(F.col("g"), 7).alias("bits")), "id", "bits", 98, 29)


@q("grid_ssim", _G + ", p as (select a.id, a.a as x, b.a as y, list_avg(a.a) as ma, list_avg(b.a) as mb from g a join g b on b.id = a.id + 1), v as (select *, list_avg(list_transform(x, lambda u: (u - ma) * (u - ma))) as va, list_avg(list_transform(y, lambda u: (u - mb) * (u - mb))) as vb, list_avg(list_transform(range(1, 65), lambda i: (x[i] - ma) * (y[i] - mb))) as cv from p) select id, round((2 * ma * mb + 0.0001::double) * (2 * cv + 0.0009::double) / ((ma * ma + mb * mb + 0.0001::double) * (va + vb + 0.0009::double)), 6) as ssim from v")
def grid_ssim(spark, d):
    t = thumbs(spark, d)
    j = t.join(t.select((F.col("id") - 1).alias("id"), F.col("g").alias("g2")), "id")
    return j.select("id", r(X.ssim(F.col("g"), F.col("g2")), "ssim"))


# --- joins of time, streams ----------------------------------------------------------------------


@q("events_during_sessions", f"with {KEY}, {EACT} select k.track_id, k.frame, count(*) as n from kb k join ea e on e.track_id = k.track_id and k.frame between e.startframe and e.endframe group by 1, 2")
def events_during(spark, d):
    k = keyboxes(spark, d).select(*K.T, "frame").withColumn("to", F.col("frame"))
    e = event_acts(spark, d).select("video_id", F.get("track_ids", F.lit(0)).alias("track_id"), "startframe", "endframe")
    return interval_join(k, e, K.T, ("frame", "to"), ("startframe", "endframe"), 24).groupBy("track_id", "frame").agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark, d, late=None):
    """Events in five batches by time; a last row far behind closes all windows."""
    end = {"event_id": -1, "user_id": -1, "event_type": "end", "value": 0.0}
    return windows.event_time(windows.replay_in_order(table(spark, d, "events"), "ts", 5, late, end), "ts")


@q("stream_tumbling", "select cast(epoch(time_bucket(interval 6 hour, ts)) as bigint) as start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, d):
    w = windows.tumbling(event_stream(spark, d), "ts", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return windows.run_to_files(w.select(F.unix_seconds("start").alias("start"), "event_type", "n"), "tumbling")


_LATE = "with b as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events), e as (select *, (epoch_us(ts) - lo) // greatest(1, (hi - lo + 1 + 4) // 5) as part from events, b) "


@q("stream_late_rows", _LATE + "select cast(epoch(time_bucket(interval 6 hour, ts)) as bigint) as start, count(*) as n from e where not (event_id % 7 = 3 and part < 2) group by 1")
def stream_late(spark, d):
    """Every seventh row of the first two batches comes three batches late: behind the watermark, so it counts nowhere."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = table(spark, d, "events").agg(F.min(us), F.max(us)).first()
    late = (F.pmod("event_id", F.lit(7)) == 3) & (F.floor((us - F.lit(lo)) / max(1, -(-(hi - lo + 1) // 5))) < 2)
    w = windows.tumbling(event_stream(spark, d, late), "ts", "6 hours", [], [F.count(F.lit(1)).alias("n")])
    return windows.run_to_files(w.select(F.unix_seconds("start").alias("start"), "n"), "late")


@q("stream_sliding", "select cast(epoch(time_bucket(interval 6 hour, ts)) - k * 21600 as bigint) as start, count(*) as n from events, range(2) t(k) group by 1")
def stream_sliding(spark, d):
    w = windows.sliding(event_stream(spark, d), "ts", "12 hours", "6 hours", [], [F.count(F.lit(1)).alias("n")])
    return windows.run_to_files(w.select(F.unix_seconds("start").alias("start"), "n"), "sliding")


_SES = "with e as (select user_id, epoch(ts) as t, lag(epoch(ts)) over (partition by user_id order by ts) as p from events), g as (select *, sum(case when p is null or t - p >= 43200 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as s from e) select user_id, cast(floor(min(t)) as bigint) as start, count(*) as n from g group by user_id, s"


@q("stream_sessions", _SES)
def stream_sessions(spark, d):
    w = windows.sessions(event_stream(spark, d), "ts", "12 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return windows.run_to_files(w.select("user_id", F.unix_seconds("start").alias("start"), "n"), "sessions")


@q("stream_count_clip", "with e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events), w as (select *, sum(value) over (partition by user_id order by event_id rows between 7 preceding and current row) as total from e) select user_id, k - 1 as endplace, round(total, 6) as total, 8 as size from w where k >= 8 and (k - 8) % 4 = 0")
def stream_count_clip(spark, d):
    w = windows.count_windows(event_stream(spark, d), "user_id", "bigint", "event_id", "value", 8, 4)
    return windows.run_to_files(w.select("user_id", "endplace", r("total", "total"), "size"), "count-clip")


@q("stream_delayed_clip", "with e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events), w as (select *, sum(value) over (partition by user_id order by event_id rows between 2 preceding and current row) as total from e) select user_id, k - 3 as startplace, k - 1 as endplace, round(total, 6) as total from w where k >= 4 and (k - 4) % 2 = 0")
def stream_delayed_clip(spark, d):
    """Clips of 3 items every 2, from the second item on."""
    w = windows.count_windows(event_stream(spark, d), "user_id", "bigint", "event_id", "value", 3, 2, 1)
    return windows.run_to_files(w.select("user_id", "startplace", "endplace", r("total", "total")), "delayed-clip")


@q("stream_clip_labels", f"with {KEY}, {EACT}, e as (select user_id, event_id, frame, row_number() over (partition by user_id order by event_id) as k from ev), w as (select user_id, k - 1 as endplace, min(frame) over p as first, frame as last, count(*) over p as size from e window p as (partition by user_id order by event_id rows between 7 preceding and current row)) select w.user_id, w.endplace, count(ea.activity_id) as activities from w left join ea on ea.track_id = w.user_id and ea.startframe <= w.last and ea.endframe >= w.first where size = 8 and (endplace - 7) % 4 = 0 group by 1, 2")
def stream_clip_labels(spark, d):
    """The clips of a stream with the activities of their track that run in them."""
    clips = windows.run_to_files(windows.count_windows(event_stream(spark, d), "user_id", "bigint", "event_id", "value", 8, 4), "clip-labels")
    at = table(spark, d, "events").select("user_id", "event_id", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473352).cast("int").alias("frame"))
    first = F.lag("frame", 7).over(Window.partitionBy("user_id").orderBy("event_id"))
    c = clips.select("user_id", "endplace", F.col("at").alias("event_id")).join(at.withColumn("first", first), ["user_id", "event_id"])
    c = c.select("user_id", "endplace", "first", F.col("frame").alias("last"))
    a = event_acts(spark, d).select(F.get("track_ids", F.lit(0)).alias("user_id"), "startframe", "endframe", "activity_id")
    met = interval_join(c, a, ["user_id"], ("first", "last"), ("startframe", "endframe"), 24).groupBy("user_id", "endplace").agg(F.count("activity_id").alias("activities"))
    return c.select("user_id", "endplace").join(met, ["user_id", "endplace"], "left").withColumn("activities", F.coalesce("activities", F.lit(0)))


@q("stream_lag_frame", "select user_id, event_id as \"at\", value from (select user_id, event_id, lag(value, 3) over (partition by user_id order by event_id) as value from events) where value is not null")
def stream_lag(spark, d):
    return windows.run_to_files(windows.delayed(event_stream(spark, d), "user_id", "bigint", "event_id", "value", 3), "lag")


@q("batch_assign_tracks")
def assign_tracks(spark, d):
    k = keyboxes(spark, d)
    b = F.col("box")
    det = k.select("video_id", "frame", (F.col("track_id") * 1000 + F.col("frame")).alias("det_id"), F.lit("any").alias("category"), "conf", *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return tracker.assign_batch(det)


QUERIES, ORACLES = Q, O
