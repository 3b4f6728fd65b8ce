"""Queries of the collection algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators.collection import POS, Collection
from framelake.plans.views import ITEM, OBJ, images, items, objects
from framelake.session import cut
from framelake.sources.tables import table

Q, O = {}, {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


I = f"with {ITEM} "  # noqa: E741


def place():
    return F.col(POS).alias("place")


@q("category_frequency", f"with {OBJ} select category as key, count(*) as n from ob where category is not null group by category")
def category_frequency(spark, d):
    return Collection(objects(spark, d, "category")).frequency("category")


@q("filter_map_count", I + "select source, n * 2 as n2 from it where n > 300")
def filter_map_count(spark, d):
    return items(spark, d).filter(F.col("n") > 300).map("source", (F.col("n") * 2).alias("n2")).df.drop(POS)


@q("count_true", I + "select count(*) filter (where n > 300) as n from it")
def count_true(spark, d):
    return items(spark, d).count(F.col("n") > 300)


@q("set_distinct", I + "select distinct source as value from it")
def set_distinct(spark, d):
    return items(spark, d).set("source")


@q("all_true", I + "select coalesce(bool_and(n >= 0), true) as value from it")
def all_true(spark, d):
    return items(spark, d).all(F.col("n") >= 0)


@q("balanced", I + "select min(c) = max(c) as balanced from (select count(*) as c from it group by source)")
def balanced(spark, d):
    return items(spark, d).balanced("source")


@q("inverse_frequency", I + ", c as (select source as key, count(*) as k from it group by source) select key, round((select sum(k) from c) / k / (select count(*) from c), 6) as weight from c")
def inverse_frequency(spark, d):
    return items(spark, d).inverse_frequency("source").withColumn("weight", F.round("weight", 6))


@q("sumby", I + "select source as key, sum(n)::bigint as total from it group by source")
def sumby(spark, d):
    return items(spark, d).sumby("source", "n")


@q("groupby_values", I + "select source as key, list(doc_id order by p) as values from it group by source")
def groupby_values(spark, d):
    return items(spark, d).groupby("source", "doc_id")


@q("most_frequent_k", I + "select source as key, count(*) as n from it group by source order by n desc, source desc limit 3")
def most_frequent_k(spark, d):
    return items(spark, d).most_frequent("source", 3)


@q("dedupe_last_value_first_place", "with x as (select text, doc_id from documents where text is not null) select text as key, max(doc_id) as doc_id, min(doc_id) as first_id from x group by text")
def dedupe(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("text", "doc_id", F.col("doc_id").alias(POS))
    return Collection(docs, dense=False).dedupe("text", "doc_id").df.withColumnRenamed(POS, "first_id")


@q("sort_stable", I + "select row_number() over (order by n, p) - 1 as place, doc_id from it")
def sort_stable(spark, d):
    return items(spark, d).sort("n").df.select(place(), "doc_id")


@q("slice_default_stop", I + "select (p - 2) // 3 as place, doc_id from it where p >= 2 and p < total - 1 and (p - 2) % 3 = 0")
def slice_default(spark, d):
    return items(spark, d).slice(2, -1, 3).df.select(place(), "doc_id")


@q("truncate_half", I + "select p as place, doc_id from it where p < 300")
def truncate(spark, d):
    return items(spark, d).truncate(300).df.select(place(), "doc_id")


@q("shift_circular", I + "select ((p - 7) % total + total) % total as place, doc_id from it")
def shift(spark, d):
    return items(spark, d).shift(7).df.select(place(), "doc_id")


@q("repeater", I + "select p * 3 + k as place, doc_id from it, range(3) t(k)")
def repeater(spark, d):
    return items(spark, d).repeat(3).df.select(place(), "doc_id")


@q("flatten_words", "with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as k from documents where text is not null) select row_number() over (order by doc_id, k) - 1 as place, word from w")
def flatten_words(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("words"))
    return Collection.of(docs, ["doc_id"]).flatten("words", "word").df.select(place(), "word")


@q("union_interleave", "with a as (select row_number() over (order by doc_id) - 1 as p, 0 as s, doc_id from documents where lang = 'en' union all select row_number() over (order by doc_id) - 1, 1, doc_id from documents where lang = 'de') select row_number() over (order by p, s) - 1 as place, doc_id from a")
def union_interleave(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    a, b = (Collection.of(docs.where(F.col("lang") == x), ["doc_id"]) for x in ("en", "de"))
    return (a | b).df.select(place(), "doc_id")


@q("zip_positional", I + "select a.p as place, a.doc_id, b.doc_id as doc_id_2 from it a join it b on b.p = a.p + 5")
def zip_positional(spark, d):
    c = items(spark, d).map("doc_id")
    n = c.size()
    return c.zip(c.slice(5, n)).df.select(place(), "doc_id", "doc_id_2")


@q("chunk_n", I + "select cast(floor(p / ceil(total / 7.0)) as bigint) as chunk, count(*) as n, min(doc_id) as first_id from it group by 1")
def chunk_n(spark, d):
    return items(spark, d).chunk(7).df.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@q("batch_n", I + "select p // 64 as batch, count(*) as n, sum(n)::bigint as chars from it where p // 64 < total // 64 group by 1")
def batch_n(spark, d):
    return items(spark, d).batch(64).df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


@q("minibatch_filtered", "with x as (select row_number() over (order by doc_id) - 1 as p, coalesce(n_chars, 0) as n from documents where source = 'issue') select p // 10 as batch, count(*) as n, sum(n)::bigint as chars from x group by 1")
def minibatch(spark, d):
    return items(spark, d).minibatch(10, F.col("source") == "issue").df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))


@q("pipeline_pairs", I + ", b as (select p // 50 as batch, list(doc_id order by p) as items from it group by 1) select coalesce(h.batch, t.batch + 2) as step, h.items as head, t.items as tail from b h full join b t on h.batch = t.batch + 2")
def pipeline(spark, d):
    return items(spark, d).pipeline(50, 3, "doc_id")


@q("pairwise", I + "select b.p as place, a.doc_id as first, b.doc_id as second from it a join it b on b.p = a.p + 1")
def pairwise(spark, d):
    return items(spark, d).pairwise("doc_id")


@q("overlap_windows", I + "select w.w as window, list(i.doc_id order by i.p) as items from (select unnest(range((max(total) - 10) // 6 + 1)) as w from it) w join it i on i.p >= w.w * 6 and i.p < w.w * 6 + 10 group by 1")
def overlap(spark, d):
    return items(spark, d).overlapping("doc_id", 10, 4)


@q("partition_tvt", I + "select case when p < ceil(total * 0.2 - 1e-9) then 'test' when p < ceil(total * 0.2 - 1e-9) + ceil(total * 0.1 - 1e-9) then 'val' else 'train' end as split, doc_id from it")
def partition(spark, d):
    return items(spark, d).partition(0.7, 0.1, 0.2).df.select("split", "doc_id")


@q("split_at", I + "select case when p < 100 then 0 else 1 end as part, count(*) as n from it group by 1")
def split_at(spark, d):
    return items(spark, d).split(100).df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@q("even_split", I + "select case when p < total // 2 then 0 else 1 end as part, count(*) as n, min(doc_id) as first_id from it where p < total // 2 * 2 group by 1")
def even_split(spark, d):
    return items(spark, d).even_split().df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@q("take_hash_sample", I + "select doc_id from it order by md5('3:' || doc_id), doc_id limit 50")
def take(spark, d):
    return items(spark, d).take(50, "doc_id", 3).df.select("doc_id")


@q("take_with_replacement", I + ", d as (select i, ('0x' || substr(md5('0:' || i), 1, 15))::bigint % (select count(*) from it) as p from (select unnest(range((select count(*) from it) + 10)) as i)) select d.i as place, it.doc_id from d join it using (p)")
def take_more(spark, d):
    c = items(spark, d)
    return c.take(c.size() + 10, "doc_id").df.select(place(), "doc_id")


@q("take_by_group", I + "select source, doc_id from (select *, row_number() over (partition by source order by md5('0:' || doc_id), doc_id) as r from it) where r <= 5")
def take_by(spark, d):
    return items(spark, d).take_by("source", 5, "doc_id").df.select("source", "doc_id")


@q("shuffle_seeded", I + "select row_number() over (order by md5('1:' || doc_id), doc_id) - 1 as place, doc_id from it")
def shuffle(spark, d):
    return items(spark, d).shuffle("doc_id", 1).df.select(place(), "doc_id")


@q("chunk_shuffle", I + "select row_number() over (order by md5('0:' || (p // 64)), md5('0:' || doc_id), doc_id) - 1 as place, doc_id from it")
def chunk_shuffle(spark, d):
    return items(spark, d).chunk_shuffle("doc_id", 64).df.select(place(), "doc_id")


@q("index_places", I + "select t.k as place, doc_id from (select unnest([5, 0, 5, 17]) as p, unnest([0, 1, 2, 3]) as k) t join it using (p)")
def index_places(spark, d):
    return items(spark, d).at([5, 0, 5, 17]).df.select(place(), "doc_id")


@q("last_item", I + "select doc_id from it order by p desc limit 1")
def last_item(spark, d):
    return items(spark, d).last().select("doc_id")


@q("map_failures_left_out", I + "select doc_id, 1000 // n as q from it where n <> 0")
def map_failures(spark, d):
    return items(spark, d).try_map(lambda r: (r["doc_id"], 1000 // r["n"]), "doc_id long, q long").df.drop(POS)


@q("category_rollup", f"with {OBJ} select category, coalesce(conf >= 0.5, false) as sure, count(*) as n, grouping(category)::int * 2 + grouping(coalesce(conf >= 0.5, false))::int as level from ob where category is not null group by rollup (category, coalesce(conf >= 0.5, false))")
def category_rollup(spark, d):
    o = objects(spark, d, "category").withColumn("sure", F.coalesce(F.col("conf") >= 0.5, F.lit(False)))
    return o.rollup("category", "sure").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@q("category_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def category_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@q("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[a], [b], []], a, b).agg(F.count(F.lit(1)).alias("n"))


@q("categories_in_both", f"with {OBJ}, img as (select * from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image) where rn = 1) select category from ob where category is not null intersect select category from img where category is not null")
def categories_in_both(spark, d):
    return objects(spark, d, "category").select("category").intersect(images(spark, d).where("category is not null").select("category"))


@q("categories_of_objects_only", f"with {OBJ}, img as (select * from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image) where rn = 1) select category from ob where category is not null except select category from img where category is not null")
def categories_of_objects_only(spark, d):
    return objects(spark, d, "category").select("category").subtract(images(spark, d).where("category is not null").select("category"))


@q("quantiles_by_category", f"with {OBJ} select category, round(quantile_cont(conf, 0.25), 6) as low, round(quantile_cont(conf, 0.5), 6) as middle, round(quantile_cont(conf, 0.9), 6) as high, count(distinct image_id) as n_images from ob where category is not null and conf is not null group by 1")
def quantiles(spark, d):
    at = F.percentile("conf", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    g = objects(spark, d, "category", "conf").groupBy("category").agg(at.alias("p"), F.count_distinct("image_id").alias("n_images"))
    return g.select("category", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("low", "middle", "high"))], "n_images")


@q("sketches_are_close", f"with {OBJ} select category, true as distinct_close, true as median_close from ob where category is not null and conf is not null group by 1 having count(*) >= 20")
def sketches(spark, d):
    """Approximate distinct counts and medians against the exact ones: within a tenth."""
    o = cut(objects(spark, d, "category", "conf").select("category", "image_id", "conf"))
    # Apart: beside a distinct count every category and image would hold the sketches.
    g = o.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("image_id", 0.01).alias("a"), F.approx_percentile("conf", 0.5, 1000).alias("am")).where("n >= 20")
    e = o.select("category", "image_id").distinct().groupBy("category").agg(F.count("image_id").alias("e"))
    upto = F.sum("k").over(Window.partitionBy("category").orderBy("conf").rowsBetween(Window.unboundedPreceding, 0))
    c = o.groupBy("category", "conf").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", upto).join(g, "category")
    at = lambda place: F.max(F.when((F.col("upto") - F.col("k") <= place) & (F.col("upto") > place), F.col("conf")))
    m = c.groupBy("category").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2).alias("em"))
    return g.join(e, "category").join(m, "category").select("category", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e") + 1).alias("distinct_close"), (F.abs(F.col("am") - F.col("em")) <= 0.1).alias("median_close"))


QUERIES, ORACLES = Q, O
