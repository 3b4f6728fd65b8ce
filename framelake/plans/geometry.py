"""Queries of boxes, points, joins by place and sets of detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions import point as P
from framelake.operators import detections as D
from framelake.plans.views import IMG, LIVE, OBJ, images, objects
from framelake.sources.tables import table

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


W = f"with {OBJ} "


class _Box:
    """The column `box`; columns cannot be made before there is a session."""

    def __getitem__(self, field: str):
        return F.col("box")[field]


b = _Box()


def r(c, name: str):
    return F.round(c, 6).alias(name)


def out(spark, d, **cols):
    return objects(spark, d).select("detection_id", *[r(c, n) for n, c in cols.items()])


def corners(c):
    return [r(c[f], f) for f in ("xmin", "ymin", "xmax", "ymax")]


@q("image_union_box", W + "select image_id, min(x1) as xmin, min(y1) as ymin, max(x2) as xmax, max(y2) as ymax from ob group by image_id")
def image_union_box(spark, d):
    return objects(spark, d).groupBy("image_id").agg(B.union_agg(b).alias("b")).select("image_id", "b.*")


@q("box_measures", W + "select detection_id, round(w, 6) as width, round(h, 6) as height, round(area, 6) as area, round(case when h <> 0 then w / h end, 6) as aspect, round(x1 + w / 2, 6) as xc, round(y1 + h / 2, 6) as yc, round(least(w, h), 6) as mindim, round(greatest(w, h), 6) as maxdim from ob")
def box_measures(spark, d):
    return out(spark, d, width=B.width(b), height=B.height(b), area=B.area(b), aspect=B.aspect_ratio(b), xc=B.xcentroid(b), yc=B.ycentroid(b), mindim=B.min_dim(b), maxdim=B.max_dim(b))


@q("box_predicates", W + "select detection_id, (w >= 0 and h >= 0) as valid, (x1 >= 0 and y1 >= 0 and x2 >= 0 and y2 >= 0) as nonneg, (x1 = round_even(x1, 0) and y1 = round_even(y1, 0) and x2 = round_even(x2, 0) and y2 = round_even(y2, 0)) as whole, w = h as square from ob")
def box_predicates(spark, d):
    return objects(spark, d).select("detection_id", B.valid(b).alias("valid"), B.nonnegative(b).alias("nonneg"), B.is_integer(b).alias("whole"), B.is_square(b).alias("square"))


@q("box_transforms", W + "select detection_id, round(x1 - 2 + 3, 6) as xmin, round(y1 - 2 - 1, 6) as ymin, round(x2 + 2 + 3, 6) as xmax, round(y2 + 2 - 1, 6) as ymax from ob")
def box_transforms(spark, d):
    return objects(spark, d).select("detection_id", *corners(B.translate(B.dilate_px(b, 2), 3, -1)))


@q("box_dilate_square", W + "select detection_id, round(x1 + w / 2 - greatest(w * 1.5, h * 1.5) / 2, 6) as xmin, round(y1 + h / 2 - greatest(w * 1.5, h * 1.5) / 2, 6) as ymin, round(x1 + w / 2 + greatest(w * 1.5, h * 1.5) / 2, 6) as xmax, round(y1 + h / 2 + greatest(w * 1.5, h * 1.5) / 2, 6) as ymax from ob")
def box_dilate_square(spark, d):
    return objects(spark, d).select("detection_id", *corners(B.max_square(B.dilate(b, 1.5))))


@q("box_rounding_even", W + "select detection_id, round_even(x1, 0) as xmin, round_even(y1, 0) as ymin, round_even(x1, 0) + round_even(w, 0) as xmax, round_even(y1, 0) + round_even(h, 0) as ymax from ob")
def box_rounding(spark, d):
    return objects(spark, d).select("detection_id", *[c for c in [B.rounded(b)[f].alias(f) for f in ("xmin", "ymin", "xmax", "ymax")]])


@q("box_flip_rotate", W + "select detection_id, round(640 - (640 - x1), 6) as xmin, round(480 - y2, 6) as ymin, round(640 - (640 - x2), 6) as xmax, round(480 - y1, 6) as ymax, round(480 - y2, 6) as rx, round(x1, 6) as ry, round(h, 6) as rw, round(w, 6) as rh from ob")
def box_flip_rotate(spark, d):
    f, c = B.fliplr(B.fliplr(B.flipud(b, 480), 640), 640), B.rot90cw(b, 480, 640)
    return objects(spark, d).select("detection_id", *corners(f), r(c["xmin"], "rx"), r(c["ymin"], "ry"), r(B.width(c), "rw"), r(B.height(c), "rh"))


@q("box_clip", W + "select detection_id, round(greatest(x1, 0), 6) as xmin, round(greatest(y1, 0), 6) as ymin, round(least(x2, 400), 6) as xmax, round(least(y2, 300), 6) as ymax from bx where least(x2, 400) > greatest(x1, 0) and least(y2, 300) > greatest(y1, 0)")
def box_clip(spark, d):
    return D.clip_to_image(objects(spark, d).withColumns({"W": F.lit(400), "H": F.lit(300)}), "W", "H").select("detection_id", *corners(b))


@q("box_affine", W + "select detection_id, round(x1 + w / 2 + 0.5 * (y1 + h / 2) + 10 - w / 2, 6) as xmin, round(2 * (y1 + h / 2) - 5 - h / 2, 6) as ymin, round(x1 + w / 2 + 0.5 * (y1 + h / 2) + 10 + w / 2, 6) as xmax, round(2 * (y1 + h / 2) - 5 + h / 2, 6) as ymax from ob")
def box_affine(spark, d):
    return objects(spark, d).select("detection_id", *corners(B.affine(b, [[1, 0.5, 10], [0, 2, -5]])))


@q("box_grid_cells", W + "select detection_id, c * 2 + r as cell, round(x1 + c * w / 3, 6) as xmin, round(y1 + r * h / 2, 6) as ymin, round(x1 + c * w / 3 + w / 3, 6) as xmax, round(y1 + r * h / 2 + h / 2, 6) as ymax from ob, range(3) x(c), range(2) y(r)")
def box_grid_cells(spark, d):
    e = objects(spark, d).select("detection_id", F.posexplode(B.grid(b, 2, 3)).alias("cell", "g"))
    return e.select("detection_id", "cell", *corners(F.col("g")))


@q("point_algebra", W + "select detection_id, round(sqrt((x1 + w / 2 - 100) ** 2 + (y1 + h / 2 - 100) ** 2), 6) as dist, sqrt((x1 + w / 2 - 100) ** 2 + (y1 + h / 2 - 100) ** 2) <= 5 + w / 2 as meets, (100 >= x1 and 100 <= x2 and 100 >= y1 and 100 <= y2) as inside from ob")
def point_algebra(spark, d):
    c, o = P.point(B.xcentroid(b), B.ycentroid(b), B.width(b) / 2), P.point(100, 100, 5)
    return objects(spark, d).select("detection_id", r(P.dist(c, o), "dist"), P.meets(c, o).alias("meets"), P.in_box(o, b).alias("inside"))


@q("ellipse_inside", W + "select detection_id, round(pi() * w / 2 * h / 2, 5) as area, coalesce(case when w > 0 and h > 0 then ((200 - (x1 + w / 2)) / (w / 2)) ** 2 + ((200 - (y1 + h / 2)) / (h / 2)) ** 2 <= 1 end, false) as inside from ob")
def ellipse_inside(spark, d):
    e = B.ellipse(b)
    return objects(spark, d).select("detection_id", F.round(P.ellipse_area(e), 5).alias("area"), F.coalesce(P.ellipse_holds(e, 200, 200), F.lit(False)).alias("inside"))


@q("homography", W + "select detection_id, round((x1 + 2 * y1 + 3) / (0.001 * x1 + 1), 6) as x, round((0.5 * x1 + y1) / (0.001 * x1 + 1), 6) as y from ob")
def homography(spark, d):
    p = P.apply_homography([[1, 2, 3], [0.5, 1, 0], [0.001, 0, 1]], P.point(b["xmin"], b["ymin"]))
    return objects(spark, d).select("detection_id", r(p["x"], "x"), r(p["y"], "y"))


_PAIR = W + """, pr as (select a.image_id, a.detection_id as a_id, b.detection_id as b_id, a.category = b.category as same, a.area as aa, b.area as ba, a.conf as ac, b.conf as bc, a.w as aw, a.h as ah, b.w as bw, b.h as bh,
 (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i
 from bx a join bx b on a.image_id = b.image_id and a.detection_id < b.detection_id and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)) """


@q("pair_iou_join", _PAIR + "select image_id, a_id, b_id, round(i / (aa + ba - i), 6) as iou, round(i / aa, 6) as cover, round(greatest(i / aa, i / ba), 6) as maxcover, round(least(aw, bw) * least(ah, bh) / (aa + ba - least(aw, bw) * least(ah, bh)), 6) as shape_iou from pr")
def pair_iou_join(spark, d):
    p = D.pair_overlaps(objects(spark, d), "image_id", "detection_id")
    return p.select("image_id", F.col("a_detection_id").alias("a_id"), F.col("b_detection_id").alias("b_id"), *[r(F.col(c), c) for c in ("iou", "cover", "maxcover", "shape_iou")])


@q("near_pairs_by_category", W + "select a.category, count(*) as pairs, count(*) filter (where i / (aa + ba - i) >= 0.3) as close from (select a.category, a.area as aa, b.area as ba, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i from bx a join bx b on a.image_id = b.image_id and a.category = b.category and a.detection_id < b.detection_id and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)) a group by a.category")
def near_pairs(spark, d):
    p = D.pair_overlaps(objects(spark, d, "category"), "image_id", "detection_id", ["category"])
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("iou") >= 0.3).alias("close"))


_AB = W + ", a as (select * from ob where detection_id % 2 = 0), b as (select * from ob where detection_id % 2 = 1) "


def halves(spark, d):
    o = objects(spark, d)
    odd = F.pmod("detection_id", F.lit(2)) == 1
    return o.where(~odd), o.where(odd)


_HIT = "a.x1 is not null and exists (select 1 from b where b.x1 is not null and b.image_id = a.image_id and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1))"


@q("semi_overlap", _AB + f"select detection_id from a where {_HIT}")
def semi_overlap(spark, d):
    return D.any_overlap(*halves(spark, d), "image_id", "detection_id").select("detection_id")


@q("anti_overlap", _AB + f"select detection_id from a where not ({_HIT})")
def anti_overlap(spark, d):
    return D.any_overlap(*halves(spark, d), "image_id", "detection_id", "left_anti").select("detection_id")


_OVER = "least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)"
_INTER = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
#: One after the other in order of confidence: who meets a kept one falls.
_NMS = W.replace("with ", "with recursive ", 1) + f""", c as (select *, row_number() over (partition by image_id order by conf desc, detection_id) as r from bx where conf > 0.3 and w >= 0 and h >= 0),
su as (select b.image_id, b.r, list(a.r) as by_r from c a join c b on a.image_id = b.image_id and a.category = b.category and a.r < b.r and {_OVER} where {_INTER} / (a.area + b.area - {_INTER}) >= 0.5 or greatest({_INTER} / a.area, {_INTER} / b.area) > 0.8 group by 1, 2),
s as (select c.image_id, c.r, c.detection_id, coalesce(su.by_r, []) as by_r from c left join su on su.image_id = c.image_id and su.r = c.r),
rec as (select image_id, r, [r] as kept from s where r = 1 union all select s.image_id, s.r, case when list_has_any(rec.kept, s.by_r) then rec.kept else list_append(rec.kept, s.r) end from rec join s on s.image_id = rec.image_id and s.r = rec.r + 1),
las as (select image_id, arg_max(kept, r) as kept from rec group by 1) """


@q("nms", _NMS + "select s.image_id, s.detection_id from s join las using (image_id) where list_contains(las.kept, s.r)")
def nms(spark, d):
    return D.nms(objects(spark, d), "image_id", "detection_id", "conf", 0.3, 0.5, 0.8, "category").select("image_id", "detection_id")


def greedy_sql(edges: str) -> str:
    """Sources of each grp in order (largest ord, smaller src) take the best free dst: rows grp, src, dst of table asg."""
    return f"""ed as ({edges}), cd as (select grp, src, list(dst order by score desc, dst) as ds, row_number() over (partition by grp order by any_value(ord) desc, src) as r from ed group by grp, src),
rec as (select grp, r, src, ds[1] as dst, [ds[1]] as used from cd where r = 1
 union all select grp, r, src, dst, case when dst is null then used else list_append(used, dst) end from (select cd.grp, cd.r, cd.src, list_filter(cd.ds, lambda x: not list_contains(rec.used, x))[1] as dst, rec.used from rec join cd on cd.grp = rec.grp and cd.r = rec.r + 1)),
asg as (select grp, src, dst from rec where dst is not null) """


def halves_sql(least: float, by: str = "") -> str:
    pairs = f"select a.image_id as grp, a.detection_id as src, b.detection_id as dst, a.area as ord, {_INTER} / (a.area + b.area - {_INTER}) as score from bx a join bx b on a.image_id = b.image_id {by} and a.detection_id % 2 = 0 and b.detection_id % 2 = 1 and {_OVER} where a.w >= 0 and a.h >= 0 and b.w >= 0 and b.h >= 0"
    return W.replace("with ", "with recursive ", 1) + ", " + greedy_sql(f"select * from ({pairs}) where score > {least}")


@q("greedy_assignment", halves_sql(0.1) + "select asg.grp as image_id, asg.src, asg.dst, round(ed.score, 6) as iou from asg join ed using (grp, src, dst)")
def greedy(spark, d):
    a = D.assign_boxes(*halves(spark, d), "image_id", "detection_id", 0.1)
    return a.select("image_id", "src", "dst", r(F.col("score"), "iou"))


@q("scene_intersection", halves_sql(0.3, "and a.category = b.category") + "select src as detection_id from asg")
def scene_intersection(spark, d):
    return D.intersection(*halves(spark, d), "image_id", "detection_id", 0.3, "category").select("detection_id")


@q("scene_difference", halves_sql(0.3, "and a.category = b.category") + "select detection_id from ob where detection_id % 2 = 0 and detection_id not in (select src from asg)")
def scene_difference(spark, d):
    return D.difference(*halves(spark, d), "image_id", "detection_id", 0.3, "category").select("detection_id")


@q("scene_union", W + "select image_id, count(*) as n from ob group by image_id")
def scene_union(spark, d):
    return D.union(*halves(spark, d), "image_id", "detection_id").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@q("scene_summary", W + "select image_id, count(*) as n_objects, coalesce(list_sort(list(distinct category) filter (where category is not null)), []) as categories, arg_min_null(category, detection_id) as primary_category, arg_max_null(category, detection_id) as last_category, max(x2) - min(x1) as width from ob group by image_id")
def scene_summary(spark, d):
    s = D.summary(objects(spark, d), "image_id", "detection_id", "category")
    return s.select("image_id", "n_objects", "categories", "primary_category", "last_category", B.width(b).alias("width"))


@q("normalized_to_pixels", f"with {LIVE}, {IMG} select l.detection_id, round(case when coalesce(normalized_coordinates, false) then xmin * width else xmin end, 6) as xmin, round(case when coalesce(normalized_coordinates, false) then ymax * height else ymax end, 6) as ymax from live l join img i on i.image_id = l.image_id where l.rn = 1")
def normalized_to_pixels(spark, d):
    from framelake.operators.live import latest

    cols = {"image_id": F.col("image_id"), "flag": F.col("normalized_coordinates"), "box": B.box("xmin", "ymin", "xmax", "ymax")}
    det = latest(table(spark, d, "detection"), "detection_id", "ingested_at", cols)
    j = D.to_pixels(det.join(images(spark, d).select("image_id", "width", "height"), "image_id"), "flag", "width", "height")
    return j.select("detection_id", r(b["xmin"], "xmin"), r(b["ymax"], "ymax"))


@q("images_without_objects", f"with {OBJ}, {IMG} select image_id from img where image_id not in (select image_id from ob)")
def images_without(spark, d):
    return images(spark, d).select("image_id").join(objects(spark, d).select("image_id"), "image_id", "left_anti")


@q("average_box_by_category", W + "select category, round(avg(x1), 6) as xmin, round(avg(y2), 6) as ymax, round(quantile_cont(w, 0.5), 6) as median_width from ob where category is not null group by category")
def average_box(spark, d):
    g = objects(spark, d, "category").groupBy("category").agg(B.mean_agg(b).alias("m"), B.median_shape_agg(b).alias("s"))
    return g.select("category", r(F.col("m.xmin"), "xmin"), r(F.col("m.ymax"), "ymax"), r(F.col("s.width"), "median_width"))


QUERIES, ORACLES = Q, O
