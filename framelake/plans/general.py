"""Queries of the general training-data operators (problems 2 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import load_names
from framelake.operators.intervals import periods_and_gaps
from framelake.operators.live import latest
from framelake.operators.skew import profile_per_key, top_per_key
from framelake.sources.tables import small_enough, table


def tasks_of(spark: SparkSession) -> int:
    """Tasks over which per-key work is balanced: at least three a core."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def live_intervals(spark: SparkSession, d: str) -> DataFrame:
    """video_id, category (normal name), startframe, endframe in frames of the video's rate."""
    names = load_names(table(spark, d, "category_ref"))
    act = table(spark, d, "activity")
    cols = {c: F.col(c) for c in ("video_id", "startframe", "endframe", "fps")} | {"code": names.code("category")}
    act = latest(act, "activity_id", "revision", cols)
    act = act.where("video_id is not null and startframe is not null and endframe is not null and code is not null")
    video = table(spark, d, "video").select("video_id", F.col("fps").alias("video_fps")).where("video_id is not null").dropDuplicates(["video_id"])
    both = act.join(F.broadcast(video) if small_enough(video) else video, "video_id", "left")

    def in_video(c: str):
        same = F.col("fps").isNull() | F.col("fps").eqNullSafe(F.col("video_fps"))
        return F.when(same, F.col(c)).otherwise(F.rint(F.try_divide(F.col(c) * F.col("video_fps"), F.col("fps"))).cast("int"))

    a, b = in_video("startframe"), in_video("endframe")
    return both.select("video_id", "code", F.least(a, b).alias("startframe"), F.greatest(a, b).alias("endframe")), names


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, names = live_intervals(spark, d)
    out = periods_and_gaps(rows, ["video_id", "code"], "startframe", "endframe")
    return out.select("video_id", names.name("code").alias("category"), "kind", "startframe", "endframe")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per category: periods, gaps, and frames in each."""
    p = p2_found(spark, d)
    length = F.col("endframe").cast("long") - F.col("startframe")
    kinds = [("period", "periods", "covered"), ("gap", "gaps", "uncovered")]
    aggs = [x for k, n, s in kinds for x in (F.count_if(F.col("kind") == k).alias(n), F.coalesce(F.sum(F.when(F.col("kind") == k, length)), F.lit(0)).alias(f"frames_{s}"))]
    return p.groupBy("category").agg(*aggs)


def _detection_tags(spark: SparkSession, d: str, names) -> DataFrame:
    live = latest(table(spark, d, "detection"), "detection_id", "ingested_at", {"conf": F.col("conf"), "codes": names.codes("tags")})
    return live.where("conf is not null").select("detection_id", "conf", F.explode("codes").alias("code"))


def _tag_loads(spark: SparkSession, d: str, names) -> DataFrame:
    """Tags of all deliveries: an estimate of the load, without the shuffle that finds the live ones."""
    return table(spark, d, "detection").where("conf is not null").select(F.explode(names.codes("tags")).alias("code"))


def _image_areas(spark: SparkSession, d: str, names) -> DataFrame:
    area = F.col("width").cast("long") * F.col("height")
    live = latest(table(spark, d, "image"), "image_id", "ingested_at", {"area": area, "code": names.code("category")})
    return live.where("area is not null and code is not null").select("image_id", "area", "code")


def _name_side(spark: SparkSession, names, *columns: str) -> DataFrame:
    """The matching side of the per-key queries: code, key_name and further columns of the names."""
    kinds = ", ".join(["code int", "key_name string", *[f"{c} string" for c in columns]])
    return spark.createDataFrame([(i, n, *(names.columns[c][i] for c in columns)) for i, n in enumerate(names.names)], kinds)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    names = load_names(table(spark, d, "category_ref"))
    n, side = tasks_of(spark), _name_side(spark, names)
    tags = top_per_key(_detection_tags(spark, d, names), "code", "conf", "detection_id", 3, side, n, _tag_loads(spark, d, names))
    cats = top_per_key(_image_areas(spark, d, names), "code", "area", "image_id", 3, side, n, table(spark, d, "image").select(names.code("category").alias("code")))
    tags = tags.select(F.lit("tag").alias("field_name"), "key_name", F.col("detection_id").alias("row_id"))
    cats = cats.select(F.lit("category").alias("field_name"), "key_name", F.col("image_id").alias("row_id"))
    return tags.unionByName(cats)


def p6_tag_profile(spark: SparkSession, d: str) -> DataFrame:
    """Confidence statistics of every tag beside the kind of its name."""
    names = load_names(table(spark, d, "category_ref"))
    out = profile_per_key(_detection_tags(spark, d, names), "code", "detection_id", "conf", _name_side(spark, names, "kind"), tasks_of(spark), _tag_loads(spark, d, names))
    return out.select("key_name", "kind", "rows", (F.floor(F.col("mean") * 1000000 + 0.4999) / 1000000).alias("mean_conf"), F.round("lowest", 6).alias("lowest_conf"), F.round("highest", 6).alias("highest_conf"))


QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage, "p6_found": p6_found, "p6_tag_profile": p6_tag_profile}

#: Separators of names, as DuckDB's translate takes them.
_SQ = "regexp_replace(lower({0}), '[\\s\\x{{00A0}}_\\-./\\\\+]+', '', 'g')"
_REF = f"ref as (select {_SQ.format('category')} as k, category as nm from category_ref union select {_SQ.format('s')}, category from (select category, unnest(synonyms) as s from category_ref))"
_ACT = f"""with {_REF},
la as (select *, row_number() over (partition by activity_id order by revision desc) as rn from activity),
iv as (select a.video_id, r.nm as category,
 case when a.fps is null or a.fps = v.fps then a.startframe else cast(round_even(a.startframe * v.fps / a.fps, 0) as int) end as s,
 case when a.fps is null or a.fps = v.fps then a.endframe else cast(round_even(a.endframe * v.fps / a.fps, 0) as int) end as e
 from la a join ref r on r.k = {_SQ.format('a.category')} left join video v on v.video_id = a.video_id
 where rn = 1 and a.video_id is not null and a.startframe is not null and a.endframe is not null),
sw as (select video_id, category, least(s, e) as s, greatest(s, e) as e from iv where s <> e),
mx as (select *, max(e) over (partition by video_id, category order by s, e rows between unbounded preceding and 1 preceding) as m from sw),
lb as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by video_id, category order by s, e rows unbounded preceding) as g from mx),
pr as (select video_id, category, g, min(s) as s, max(e) as e from lb group by all),
pg as (select video_id, category, 'period' as kind, s as startframe, e as endframe from pr
 union all select video_id, category, 'gap', pe, s from (select *, lag(e) over (partition by video_id, category order by s) as pe from pr) where pe is not null)
"""
_DET = f"""with {_REF},
ld as (select detection_id, conf, tags, row_number() over (partition by detection_id order by ingested_at desc) as rn from detection),
dt as (select distinct detection_id, conf, r.nm as key_name from (select detection_id, conf, unnest(tags) as t from ld where rn = 1 and conf is not null) x join ref r on r.k = {_SQ.format('x.t')})
"""
ORACLES = {
    "p2_found": _ACT + "select video_id, category, kind, startframe, endframe from pg",
    "p2_coverage": _ACT
    + """select category, count(*) filter (where kind = 'period') as periods, coalesce(sum(cast(endframe as bigint) - startframe) filter (where kind = 'period'), 0)::bigint as frames_covered,
count(*) filter (where kind = 'gap') as gaps, coalesce(sum(cast(endframe as bigint) - startframe) filter (where kind = 'gap'), 0)::bigint as frames_uncovered from pg group by category""",
    "p6_found": _DET
    + f""", li as (select image_id, category, cast(width as bigint) * height as area, row_number() over (partition by image_id order by ingested_at desc) as rn from image),
ic as (select image_id, area, r.nm as key_name from li join ref r on r.k = {_SQ.format('li.category')} where rn = 1 and area is not null)
select 'tag' as field_name, key_name, detection_id as row_id from (select *, row_number() over (partition by key_name order by conf desc, detection_id) as q from dt) where q <= 3
union all select 'category', key_name, image_id from (select *, row_number() over (partition by key_name order by area desc, image_id) as q from ic) where q <= 3""",
    "p6_tag_profile": _DET
    + """select key_name, max(c.kind) as kind, count(*) as rows, floor(avg(conf) * 1000000 + 0.4999) / 1000000 as mean_conf, round(min(conf), 6) as lowest_conf, round(max(conf), 6) as highest_conf
from dt join category_ref c on c.category = key_name group by key_name""",
}
