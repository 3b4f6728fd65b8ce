"""Queries of the remaining scalar families, archives, assignments and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions import numeric as N
from framelake.functions import pixels as X
from framelake.functions import point as P
from framelake.functions import strings as S
from framelake.functions import tags as G
from framelake.operators import activities as A
from framelake.operators import detections as D
from framelake.operators import matrix as M
from framelake.operators import metrics as R
from framelake.operators import scene as C
from framelake.operators import tracks as K
from framelake.operators.collection import POS, Collection
from framelake.operators.intervals import periods_and_gaps
from framelake.plans.geometry import greedy_sql
from framelake.plans.scenes import _G, _M, _PM, _SC, DENSE, counts, event_stream, scores, thumbs
from framelake.plans.views import ACT, IMG, ITEM, KEY, OBJ, acts, images, items, keyboxes, objects
from framelake.sources import readers
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


W = f"with {OBJ} "


@q("box_corners_centroid", W + "select detection_id, x1 as ulx, y1 as uly, x2 as urx, y2 as lly, round(x1 + w / 2 - 5, 6) as cx, round(y1 + h / 2 + 5, 6) as cy from ob")
def box_corners(spark, d):
    b = F.col("box")
    c = B.from_centroid(B.xcentroid(b), B.ycentroid(b), 10, 10)
    return objects(spark, d).select("detection_id", B.corner(b, "ul")["x"].alias("ulx"), B.corner(b, "ul")["y"].alias("uly"), B.corner(b, "ur")["x"].alias("urx"), B.corner(b, "ll")["y"].alias("lly"), r(c["xmin"], "cx"), r(c["ymax"], "cy"))


@q("box_distances", W + "select detection_id, round((x1 - 10) ** 2 + (y1 - 20) ** 2, 6) as sqdist, round(sqrt((x1 + w / 2 - 20) ** 2 + (y1 + h / 2 - 30) ** 2), 6) as dist, round(abs(w - 20) + abs(h - 20), 6) as shapedist, round(10 - x1, 6) as dx, round(exp(-((x1 - 10) ** 2 + (y1 - 20) ** 2) / (2 * 50.0 * 50.0)), 6) as pdist from ob")
def box_distances(spark, d):
    b, o = F.col("box"), B.box(10, 20, 30, 40)
    return objects(spark, d).select("detection_id", r(B.sqdist(b, o), "sqdist"), r(B.dist(b, o), "dist"), r(B.shape_dist(b, o), "shapedist"), r(B.dx(b, o), "dx"), r(B.pdist(b, o, 50), "pdist"))


_T = "x1 is not null and least(x2, 200) > greatest(x1, 100) and least(y2, 250) > greatest(y1, 150)"


@q("box_thresholds", W + f", t as (select *, case when {_T} then (least(x2, 200) - greatest(x1, 100)) * (least(y2, 250) - greatest(y1, 150)) else 0 end as i from ob) select detection_id, {_T} as meets, ({_T} and (case when area > 0 then i / area else 0 end >= 0.5 or i / 10000 > 0.9 or (area > 0 and i / area > 0.9))) as close, ({_T} and x1 >= 100 and x2 <= 200 and y1 >= 150 and y2 <= 250) as inside from t")
def box_thresholds(spark, d):
    b, o = F.col("box"), B.box(100, 150, 200, 250)
    return objects(spark, d).select("detection_id", B.overlaps(b, o).alias("meets"), B.has_intersection(b, o, at_cover=0.5, above_maxcover=0.9).alias("close"), B.inside(b, o).alias("inside"))


@q("box_even_corners", W + "select detection_id, floor(round_even(x1, 0) / 2) * 2 as xmin, floor((round_even(x1, 0) + round_even(w, 0)) / 2) * 2 as xmax from ob")
def box_even(spark, d):
    e = B.even(F.col("box"))
    return objects(spark, d).select("detection_id", e["xmin"].alias("xmin"), e["xmax"].alias("xmax"))


@q("box_min_square_resize", W + "select detection_id, round(x1 + w / 2 - least(w, h) / 2, 6) as xmin, round(y1 + h / 2 + least(w, h) / 2, 6) as ymax, round((x1 + w / 2 - 8) * 0.5, 6) as rx from ob")
def box_min_square(spark, d):
    b = F.col("box")
    return objects(spark, d).select("detection_id", r(B.min_square(b)["xmin"], "xmin"), r(B.min_square(b)["ymax"], "ymax"), r(B.rescale(B.resized(b, 16, 16), 0.5)["xmin"], "rx"))


@q("box_to_interior", W + ", m as (select detection_id, x1 + greatest(-x1, 0) as x1, x2 + greatest(-x1, 0) as x2 from bx where x1 < 400 and x2 > 0 and y1 < 300 and y2 > 0 and w > 0 and h > 0) select detection_id, round(greatest(x1 - greatest(x2 - 400, 0), 0), 6) as xmin, round(least(x2 - greatest(x2 - 400, 0), 400), 6) as xmax from m")
def box_interior(spark, d):
    o = objects(spark, d).withColumn("t", B.to_interior(F.col("box"), 400, 300)).where("t is not null")
    return o.select("detection_id", r("t.xmin", "xmin"), r("t.xmax", "xmax"))


@q("point_transforms", W + "select detection_id, round(640 - 2 * (x1 + 3), 6) as x, round(2 * (y1 - 4), 6) as y, round(480 - y1, 6) as rx, round(x1, 6) as ry from ob")
def point_transforms(spark, d):
    p = P.point(F.col("box.xmin"), F.col("box.ymin"), 1)
    a, c = P.fliplr(P.rescale(P.translate(p, 3, -4), 2), 640), P.rot90cw(p, 480, 640)
    return objects(spark, d).select("detection_id", r(a["x"], "x"), r(a["y"], "y"), r(c["x"], "rx"), r(c["y"], "ry"))


@q("covariance_ellipse", W + ", c as (select category, var_pop(x1) as a, covar_pop(x1, y1) as b, var_pop(y1) as c, count(*) as n from ob where category is not null group by category) select category, round(sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)), 4) as major, round(sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)), 3) as minor from c where n > 20")
def covariance_ellipse(spark, d):
    x, y = F.col("box.xmin"), F.col("box.ymin")
    g = objects(spark, d, "category").groupBy("category").agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 20")
    e = P.covariance_ellipse(F.col("a"), F.col("b"), F.col("c"), F.lit(0.0), F.lit(0.0))
    return g.select("category", r(e["major"], "major", 4), r(e["minor"], "minor", 3))


@q("image_tiles", f"with {IMG} select image_id, x * 192 as xmin, y * 256 as ymin from img, range(200) a(x), range(200) b(y) where width >= 256 and height >= 256 and x * 192 <= width - 256 and y * 256 <= height - 256")
def image_tiles(spark, d):
    t = X.tiles(F.col("width"), F.col("height"), 256, 256, 64, 0)
    return images(spark, d).select("image_id", F.explode(t).alias("t")).select("image_id", F.col("t.xmin").cast("int").alias("xmin"), F.col("t.ymin").cast("int").alias("ymin"))


@q("montage_layout", f"with {ITEM} select doc_id, cast(floor(p / ceil(sqrt(total))) as bigint) as row, cast(p % cast(ceil(sqrt(total)) as bigint) as bigint) as col from it")
def montage(spark, d):
    c = items(spark, d)
    m = X.montage_place(F.col(POS), F.lit(c.size()))
    return c.df.select("doc_id", m["row"].alias("row"), m["col"].alias("col"))


@q("grid_masks", _G + ", m as (select id, k, case when k % 8 >= 2 and k % 8 < 5 and k // 8 >= 1 and k // 8 < 4 then 0 else a[k + 1] end as v from g, range(64) t(k)) select id, round(sum(v), 5) as kept, round(max(v), 6) as top from m group by id")
def grid_masks(spark, d):
    m = X.apply_mask(F.col("g"), X.mask(8, 8, B.box(2, 1, 5, 4)), 0.0)
    return thumbs(spark, d).select("id", r(X.total(m), "kept", 5), r(X.maximum(m), "top"))


@q("grid_pad_blend", _G + "select id, round(list_sum(a) + 36 * 0.5, 5) as padded, round((a[1] + a[8]) / 2, 6) as blended, round(a[1] / (list_sum(a) + 1e-6), 4) as share from g where abs(list_sum(a)) > 0.05")
def grid_pad(spark, d):
    g = F.col("g")
    first = lambda x: F.get(F.get(x, F.lit(0)), F.lit(0))
    t = thumbs(spark, d).where(F.abs(X.total(g)) > 0.05)
    return t.select("id", r(X.total(X.pad(g, 1, 1, 0.5)), "padded", 5), r(first(X.blend(g, X.fliplr(g), 0.5)), "blended"), r(first(X.sum_to_one(g)), "share", 4))


@q("grid_luminance_blur", _G + "select id, round(a[1] * 0.299 + a[8] * 0.587 + a[57] * 0.114, 6) as luma, round((a[1] + a[2] + a[9] + a[10]) / 4, 6) as blur, round(a[1], 6) as block from g")
def grid_luminance(spark, d):
    g = F.col("g")
    first = lambda x: F.get(F.get(x, F.lit(0)), F.lit(0))
    return thumbs(spark, d).select("id", r(first(X.luminance(g, X.fliplr(g), X.flipud(g))), "luma"), r(first(X.box_blur(g, 1)), "blur"), r(F.get(F.get(X.pixelate(g, 4), F.lit(3)), F.lit(2)), "block"))


_BLUR = _G + ", k as (select k, exp(-0.5 * k * k) / sqrt(2 * pi()) as w from (values (-2), (-1), (0), (1), (2)) t(k)), xy as (select id, a, y, x from g, range(8) t(y), range(8) s(x)), bl as (select id, y, x, sum(ky.w * kx.w * a[(case when y + ky.k < 0 then -(y + ky.k) when y + ky.k > 7 then 14 - (y + ky.k) else y + ky.k end) * 8 + (case when x + kx.k < 0 then -(x + kx.k) when x + kx.k > 7 then 14 - (x + kx.k) else x + kx.k end) + 1]) as v from xy, k ky, k kx group by 1, 2, 3) "


@q("grid_pyramid", _BLUR + "select id, round(sum(v), 5) as blurred, round(sum(v) filter (where y % 2 = 0 and x % 2 = 0), 5) as half, round(any_value(list_sum(a)) - sum(v), 5) as detail from bl join g using (id) group by id")
def grid_pyramid(spark, d):
    g = F.col("g")
    blurred, half = X.gaussian_pyramid(g, 8, 8)
    detail = X.laplacian_pyramid(g, 8, 8)[0]
    return thumbs(spark, d).select("id", r(X.total(blurred), "blurred", 5), r(X.total(half), "half", 5), r(X.total(detail), "detail", 5))


_LIN = "greatest(0, least(({0} + 0.5) * 8 / {1} - 0.5, 7.0))::double"


@q("grid_resize", _G + f", p as (select id, a, i, j, {_LIN.format('i', 12)} as y, {_LIN.format('j', 5)} as x from g, range(12) t(i), range(5) s(j)), q as (select *, floor(y)::int as y0, floor(x)::int as x0, least(floor(y)::int + 1, 7) as y1, least(floor(x)::int + 1, 7) as x1 from p) select id, round(sum((a[y0 * 8 + x0 + 1] * (1 - (x - x0)) + a[y0 * 8 + x1 + 1] * (x - x0)) * (1 - (y - y0)) + (a[y1 * 8 + x0 + 1] * (1 - (x - x0)) + a[y1 * 8 + x1 + 1] * (x - x0)) * (y - y0)), 5) as linear, round(sum(a[floor((i + 0.5) * 8 / 12)::int * 8 + floor((j + 0.5) * 8 / 5)::int + 1]), 5) as nearest from q group by id")
def grid_resize(spark, d):
    g = F.col("g")
    return thumbs(spark, d).select("id", r(X.total(X.resized(g, 8, 8, 12, 5)), "linear", 5), r(X.total(X.resized(g, 8, 8, 12, 5, nearest=True)), "nearest", 5))


@q("grid_noise", _G + ", p as (select id, a[i * 8 + j + 1] + 0.2 * (('0x' || substr(md5('3:' || id || ':' || i || ':' || j), 1, 8))::bigint / 4294967296.0::double - 0.5) as v from g, range(8) t(i), range(8) s(j)) select id, round(sum(v), 5) as total, round(max(v), 6) as top from p group by id")
def grid_noise(spark, d):
    n = X.noised(F.col("g"), F.col("id"), 0.1, 3)
    return thumbs(spark, d).select("id", r(X.total(n), "total", 5), r(X.maximum(n), "top"))


@q("content_digests", "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents where text is not null")
def content_digests(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return readers.with_digests(t).select("doc_id", "md5", "sha1", "sha256")


@q("verified_contents", "select doc_id from documents where text is not null and doc_id % 3 <> 0")
def verified_contents(spark, d):
    """Contents whose stated digest is right; a third of the statements are not."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    stated = readers.with_digests(t).select("path", F.when(F.col("path").cast("long") % 3 == 0, F.lit("0")).otherwise(F.upper("sha1")).alias("sha1"))
    return readers.verified(t, stated).select(F.col("path").cast("long").alias("doc_id"))


@q("unit_vectors", "with e as (select vec_id, embedding::double[] as a from embeddings) select vec_id, round(a[1] / (sqrt(list_dot_product(a, a)) + 1e-16), 6) as first, round((a[2] * 2 - 0.5) / 0.25, 6) as white from e")
def unit_vectors(spark, d):
    a = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", r(F.get(N.unit(a), F.lit(0)), "first"), r(F.get(N.whiten(a, 0.5, 0.25, 2.0), F.lit(1)), "white"))


@q("interpolate_1d", "select p_partkey, round(case when p_size <= 10 then 1.0::double when p_size <= 20 then 1 + (p_size - 10) * 0.4 when p_size <= 40 then 5 - (p_size - 20) * 0.2 else 1 end::double, 6) as y from part")
def interpolate_1d(spark, d):
    return table(spark, d, "part").select("p_partkey", r(N.interp1d([10, 20, 40], [1, 5, 1], F.col("p_size").cast("double")), "y"))


@q("closest_divisor", "select p_partkey, (select k from range(1, 121) t(k) where 120 % k = 0 order by abs(k - p_size), k limit 1) as k from part")
def closest_divisor(spark, d):
    return table(spark, d, "part").select("p_partkey", N.closest_divisor(F.lit(120), F.col("p_size")).cast("long").alias("k"))


@q("column_stochastic", _M + "select i, j, round(v / sum(v) over (partition by j), 6) as v from m")
def column_stochastic(spark, d):
    return M.column_stochastic(counts(spark, d)).select("i", "j", r("v", "v"))


@q("row_signed_root", _M + ", sr as (select i, j, sqrt(v) as v from m) select i, j, round(v / sqrt(sum(v * v) over (partition by i)), 6) as v from sr")
def row_signed_root(spark, d):
    return M.row_signed_root(counts(spark, d)).select("i", "j", r("v", "v"))


@q("row_softmax", _M + ", e as (select i, j, exp((v - max(v) over (partition by i)) / 5) as e from m) select i, j, round(e / sum(e) over (partition by i), 6) as v from e")
def row_softmax(spark, d):
    return M.row_softmax(counts(spark, d), 5.0).select("i", "j", r("v", "v"))


@q("precision_recall", _SC + ", bb as (select floor(score * 10000 + 0.5) / 10000 as t, count(*) filter (where match = 1) as p, count(*) as k from sc group by 1) select t as threshold, round(sum(p) over w / (sum(k) over w)::double, 6) as precision, round(sum(p) over w / (select sum(p) from bb)::double, 6) as recall from bb window w as (order by t desc rows unbounded preceding)")
def precision_recall(spark, d):
    return R.precision_recall(scores(spark, d), "score", "match").select("threshold", r("precision", "precision"), r("recall", "recall"))


@q("path_surgery", f"""with {IMG}, s as (select image_id, filename, regexp_replace(filename, '[/\\\\]?[^/\\\\]*$', '') as folder, regexp_extract(filename, '([^/\\\\]*)$', 1) as tail from img)
select image_id, 'out/' || tail as moved, case when folder = '' then 'x_' || tail else folder || '/x_' || tail end as prefixed, case when starts_with(filename, '/data/') then '/new/' || substr(filename, 7) else filename end as rebased from s""")
def path_surgery(spark, d):
    f = "filename"
    return images(spark, d).select("image_id", S.new_path(f, "out/").alias("moved"), S.new_prefix(f, "x_").alias("prefixed"), S.repath(f, "/data/", "/new/").alias("rebased"))


@q("html_escape", "select doc_id, replace(replace(replace(replace(replace(text, chr(10), '<br>'), '{', '&#123;'), '}', '&#125;'), '\"', '&quot;'), '''', '&#39;') as html from documents where text is not null")
def html_escape(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.escaped("text").alias("html"))


@q("attribute_maps", f"with {IMG} select image_id, cardinality(confidences) as n, confidences['outdoor'] as outdoor from img where confidences is not null")
def attribute_maps(spark, d):
    i = images(spark, d).where("confidences is not null")
    c = G.public(G.set_attribute(F.col("confidences"), "__seen", 1.0))
    return i.select("image_id", F.size(c).cast("long").alias("n"), G.confidence(F.col("confidences"), "outdoor").alias("outdoor"))


@q("archive_round_trip", W + "select detection_id::varchar as id, category, conf, x1 as xmin, y2 as ymax from ob")
def archive_round_trip(spark, d):
    o = objects(spark, d)
    j = o.select(readers.to_envelope(readers.detection_json(F.col("detection_id"), F.col("category"), F.col("conf"), F.col("box")), "Detection").alias("j"))
    e = readers.unwrap(j, "j", "Detection").select(readers.parse_detection(F.col("payload")).alias("o"))
    return e.select("o.id", "o.category", "o.conf", F.col("o.box.xmin").alias("xmin"), F.col("o.box.ymax").alias("ymax"))


_GTA = DENSE.replace("with ", "with recursive ", 1) + ", " + _PM + ", tr as (select track_id, max(frame) - min(frame) + 1 as length, coalesce(avg(conf), 0) as confidence from kb group by 1), bo as (select video_id, a_track as s, b_track as t, top_iou from pm where max_iou > 0.1 union all select video_id, b_track, a_track, top_iou from pm where max_iou > 0.1), " + greedy_sql("select bo.video_id as grp, s as src, t as dst, x.length as ord, top_iou * y.confidence as score from bo join tr x on x.track_id = s join tr y on y.track_id = t where s // 5 % 2 = 1 and t // 5 % 2 = 0 and top_iou * y.confidence > 0")


@q("greedy_track_assignment", _GTA + "select asg.grp as video_id, asg.src, asg.dst, round(ed.score, 6) as score from asg join ed using (grp, src, dst)")
def track_assignment(spark, d):
    """Tracks of odd number to those of even number of a video, longest first, by ranked IoU and confidence."""
    k = keyboxes(spark, d)
    s = K.stats(k).select(*K.T, "length", "confidence")
    odd = F.pmod(F.floor(F.col("track_id") / 5), F.lit(2)) == 1
    p = K.pair_metrics(k.where(odd), [], other=k.where(~odd)).where("max_iou > 0.1")
    both = p.select("video_id", F.col("a_track").alias("src"), F.col("b_track").alias("dst"), "top_iou")
    e = both.join(s.select("video_id", F.col("track_id").alias("src"), "length"), ["video_id", "src"]).join(s.select("video_id", F.col("track_id").alias("dst"), "confidence"), ["video_id", "dst"])
    e = e.withColumn("score", F.col("top_iou") * F.col("confidence")).where("score > 0")
    return D.greedy_assignment(e, "video_id", "src", "dst", F.col("length"), F.col("score")).select("video_id", "src", "dst", r("score", "score"))


@q("activity_merge", f"with {ACT}, x as (select video_id, category, actor_id, startframe as s, endframe as e, max(endframe) over (partition by video_id, category, actor_id order by startframe, endframe rows between unbounded preceding and 1 preceding) as m from act where endframe > startframe), g as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by video_id, category, actor_id order by s, e rows unbounded preceding) as g from x) select video_id, category, actor_id, min(s) as startframe, max(e) as endframe from g group by video_id, category, actor_id, g")
def activity_merge(spark, d):
    p = periods_and_gaps(acts(spark, d), ["video_id", "category", "actor_id"], "startframe", "endframe")
    return p.where("kind = 'period'").drop("kind")


@q("activity_reframe", f"with {ACT} select activity_id, cast(round_even(startframe * 0.4, 0) as int) as startframe, cast(round_even(endframe * 0.4, 0) as int) as endframe from act")
def activity_reframe(spark, d):
    return C.reframe_activities(acts(spark, d), 0.4).select("activity_id", "startframe", "endframe")


@q("activity_tracks", f"with {ACT} select activity_id, len(track_ids) as n, coalesce(list_contains(track_ids, actor_id), false) as actor_in from act where track_ids is not null")
def activity_tracks(spark, d):
    a = acts(spark, d).where("track_ids is not null")
    return a.select("activity_id", F.size("track_ids").cast("long").alias("n"), F.coalesce(F.array_contains("track_ids", F.col("actor_id")), F.lit(False)).alias("actor_in"))


@q("activity_secondary_clips", f"with {ACT}, c as (select a.*, greatest(a.startframe - 5, 0) as cs, least(a.endframe + 5, v.n_frames) as ce from act a join video v using (video_id) where a.endframe > a.startframe) select c.activity_id, b.activity_id as other_id from c join act b on b.video_id = c.video_id and b.activity_id <> c.activity_id and least(c.ce, b.endframe) > greatest(c.cs, b.startframe) and list_has_any(c.track_ids, b.track_ids) where c.ce > c.cs")
def activity_secondary(spark, d):
    v = table(spark, d, "video").select("video_id", "n_frames")
    a = acts(spark, d)
    c = A.clips(a, v, "video_id", "activity_id", "activity_id", 5)
    return A.secondary(c, a, "video_id", "activity_id", "track_ids").select("activity_id", F.col("activity_id_2").alias("other_id"))


@q("track_upsert_delete", f"with {KEY} select track_id, frame, round(case when frame % 100 = 0 then x1 + 1 else x1 end, 6) as xmin from kb where frame % 7 <> 0")
def track_upsert(spark, d):
    k = keyboxes(spark, d)
    new = K.shift(k.where(F.pmod("frame", F.lit(100)) == 0), dx=1)
    out = K.delete(K.upsert(k, new), k.where(F.pmod("frame", F.lit(7)) == 0).select(*K.T, "frame"))
    return out.select("track_id", "frame", r("box.xmin", "xmin"))


@q("track_rekey", f"with {KEY} select case when track_id % 2 = 0 then track_id + 1000 else track_id end as track_id, frame from kb")
def track_rekey(spark, d):
    k = keyboxes(spark, d)
    m = k.where(F.pmod("track_id", F.lit(2)) == 0).select("video_id", F.col("track_id").alias("old"), (F.col("track_id") + 1000).alias("new")).distinct()
    return C.rekey(k, m).select("track_id", "frame")


@q("mosaic_frames", f"{DENSE}, f as (select video_id, frame, count(*) as n from dn group by 1, 2), nx as (select video_id, lead(video_id) over (order by video_id) as right_video from (select distinct video_id from kb)) select l.video_id as left_video, r.video_id as right_video, l.frame, l.n as left_boxes, r.n as right_boxes from f l join nx using (video_id) join f r on r.video_id = nx.right_video and r.frame = l.frame")
def mosaic(spark, d):
    """Frames of every video beside those of the next one."""
    k = keyboxes(spark, d)
    f = K.dense(k).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    v = Collection.of(k.select("video_id").distinct(), ["video_id"], "videos").df
    left = f.join(v.select("video_id", (F.col(POS) + 1).alias("next")), "video_id").select(F.col("video_id").alias("left_video"), "next", "frame", F.col("n").alias("left_boxes"))
    right = f.join(v.select("video_id", F.col(POS).alias("next")), "video_id").select(F.col("video_id").alias("right_video"), "next", "frame", F.col("n").alias("right_boxes"))
    return left.join(right, ["next", "frame"]).select("left_video", "right_video", "frame", "left_boxes", "right_boxes")


@q("key_max_min", f"with {ITEM}, c as (select source, count(*) as n from it group by source) select (select source from c order by n desc, source limit 1) as most, (select source from c order by n, source limit 1) as least")
def key_max_min(spark, d):
    c = items(spark, d).df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    first = c.groupBy("n").agg(F.min("source").alias("source"))
    return first.agg(F.max_by("source", "n").alias("most"), F.min_by("source", "n").alias("least"))


@q("triplets_padded", f"with {ITEM} select p // 3 as triplet, max(case when p % 3 = 0 then doc_id end) as a, max(case when p % 3 = 1 then doc_id end) as b, max(case when p % 3 = 2 then doc_id end) as c from it group by 1")
def triplets(spark, d):
    b = items(spark, d).batch(3, ragged=True).df
    at = lambda k: F.max(F.when(F.pmod(POS, F.lit(3)) == k, F.col("doc_id")))
    return b.groupBy(F.col("batch").alias("triplet")).agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


@q("chunks_by_sizes", f"with {ITEM} select case when p < 10 then 0 when p < 60 then 1 else 2 end as part, count(*) as n, min(doc_id) as first_id from it where p < 160 group by 1")
def chunks_by_sizes(spark, d):
    return items(spark, d).chunks([10, 50, 100]).df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@q("take_fraction", f"with {ITEM} select doc_id from it order by md5('9:' || doc_id), doc_id limit (select cast(floor(count(*) * 0.05) as bigint) from documents)")
def take_fraction(spark, d):
    return items(spark, d).take_fraction(0.05, "doc_id", 9).df.select("doc_id")


@q("stream_assign_tracks")
def stream_assign(spark, d):
    e = event_stream(spark, d)
    hour = (F.floor(F.unix_seconds("ts") / 3600) - 473352).cast("int")
    x, y = F.col("value"), F.pmod("event_id", F.lit(100)).cast("double")
    det = e.where("event_id >= 0").select(F.pmod("user_id", F.lit(5)).alias("video_id"), hour.alias("frame"), F.col("event_id").alias("det_id"), F.col("event_type").alias("category"), (F.pmod("event_id", F.lit(10)) / 10.0).alias("conf"), x.alias("xmin"), y.alias("ymin"), (x + 20).alias("xmax"), (y + 30).alias("ymax"), "ts")
    return windows.run_to_files(tracker.assign_stream(det), "assign")


@q("stream_distinct_late", "select cast(epoch(time_bucket(interval 1 day, ts)) as bigint) as start, count(distinct user_id) as users from events group by 1")
def stream_distinct(spark, d):
    """Distinct users by day, exact: a second aggregate over the stream's own counts."""
    w = windows.distinct_by_window(event_stream(spark, d), "ts", "1 day", "user_id")
    return windows.run_to_files(w.select(F.unix_seconds("start").alias("start"), F.col("n").alias("users")), "distinct")


@q("assign_activities", f"with {ACT}, a as (select video_id, category, actor_id, startframe, endframe, coalesce(conf, 0) as conf from act where startframe < endframe) select sum(conf) > 0 as any_conf, (select count(*) from (select distinct video_id, category, actor_id from a)) as keys, min(startframe) as lo, max(endframe) as hi from a")
def assign_activities(spark, d):
    """What merging keeps whatever the threshold: the keys, the first start and the last end."""
    a = tracker.assign_activities(acts(spark, d))
    k = a.select("video_id", "category", "actor_id").distinct().agg(F.count(F.lit(1)).alias("keys"))
    return a.agg((F.sum("conf") > 0).alias("any_conf"), F.min("startframe").alias("lo"), F.max("endframe").alias("hi")).join(k, how="cross").select("any_conf", "keys", "lo", "hi")


QUERIES, ORACLES = Q, O
