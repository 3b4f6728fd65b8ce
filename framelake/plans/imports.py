"""Queries of the importers: tables are written in each published layout and read back by its recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.plans.views import ACT, EACT, IMG, KEY, OBJ, acts, event_acts, images, keyboxes, objects
from framelake.session import shared_folder
from framelake.sources import importers as I
from framelake.sources import readers as R
from framelake.sources.tables import table

Q, O = {}, {}


def q(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, sql
        return f

    return add


def as_json(df: DataFrame, name: str) -> str:
    path = shared_folder(df.sparkSession, name)
    df.write.json(path)
    return path


def as_lines(df: DataFrame, line: Column, name: str, sep: str | None = None) -> DataFrame:
    """The lines written as text and read again (column value)."""
    path = shared_folder(df.sparkSession, name)
    w = df.select(line.alias("value")).where("value is not null").write
    (w.option("lineSep", sep) if sep else w).text(path)
    r = df.sparkSession.read
    return (r.option("lineSep", sep) if sep else r).text(path)


def as_csv(df: DataFrame, name: str, sep: str = ",", header: bool = False) -> DataFrame:
    """The table written as separated text and read again with its own types."""
    path = shared_folder(df.sparkSession, name)
    R.write_csv(df, path, header, sep)
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return R.read_csv(df.sparkSession, path, sep, header, schema=schema)


def as_table(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ref(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category_ref").select("category_id", "category", "supercategory")


def known(spark: SparkSession, d: str) -> DataFrame:
    """Objects with a box whose category is written as in the reference: with its number."""
    return objects(spark, d, "category").where("box is not null").join(F.broadcast(ref(spark, d)), "category")


def xywh(b: Column) -> list[Column]:
    return [b["xmin"], b["ymin"], B.width(b), B.height(b)]


b_ = lambda c: [F.col(f"box.{f}").alias(f) for f in c]
CORNERS = ("xmin", "ymin", "xmax", "ymax")
KN = f"with {OBJ}, {IMG}, kn as (select o.*, r.category_id, r.supercategory, x1 + w as xw, y1 + h as yh from bx o join category_ref r on r.category = o.category) "
FACE = "f as (select face_id, any_value(filename) as filename, any_value(xmin) as xmin, any_value(ymin) as ymin, any_value(xmax) as xmax, any_value(ymax) as ymax, any_value(conf) as conf from face group by face_id)"
TAIL, PARENT = "regexp_extract({0}, '([^/\\\\]*)$', 1)", "regexp_extract(regexp_replace({0}, '[/\\\\]?[^/\\\\]*$', ''), '([^/\\\\]*)$', 1)"


def faces(spark: SparkSession, d: str) -> DataFrame:
    cols = ("filename", "xmin", "ymin", "xmax", "ymax", "conf")
    return table(spark, d, "face").groupBy("face_id").agg(*[F.any_value(c).alias(c) for c in cols])


# --- documents ----------------------------------------------------------------------------------


def coco_docs(spark: SparkSession, d: str) -> DataFrame:
    part = F.floor(F.col("image_id") / 1000).alias("part")
    i = images(spark, d).groupBy(part).agg(F.collect_list(F.struct(F.col("image_id").alias("id"), F.col("filename").alias("file_name"))).alias("images"))
    o = known(spark, d)
    a = o.groupBy(part).agg(F.collect_list(F.struct("image_id", F.col("category_id").cast("bigint").alias("category_id"), F.array(*xywh(F.col("box"))).alias("bbox"), F.col("conf").alias("score"))).alias("annotations"))
    c = ref(spark, d).groupBy(F.lit(-1).cast("bigint").alias("part")).agg(F.collect_list(F.struct(F.col("category_id").alias("id"), F.col("category").alias("name"))).alias("categories"))
    docs = i.join(a, "part", "full_outer").unionByName(c, allowMissingColumns=True).drop("part")
    return R.read_json(spark, as_json(docs, "coco"), I.COCO)


@q("import_coco", KN + "select i.image_id, i.filename as uri, k.category, k.conf, x1 as xmin, y1 as ymin, xw as xmax, yh as ymax from img i left join kn k using (image_id)")
def import_coco(spark, d):
    return I.coco(coco_docs(spark, d)).select("image_id", "uri", "category", "conf", *b_(CORNERS))


@q("import_one_label", KN + "select i.image_id, i.filename as uri, min(k.category) as category from img i left join kn k using (image_id) group by 1, 2")
def import_one_label(spark, d):
    return I.one_label(I.coco(coco_docs(spark, d)))


@q("import_coco_classification", KN + "select k.image_id, k.category, x1 as xmin, yh as ymax from img i join kn k using (image_id)")
def import_classification(spark, d):
    return I.as_classification(I.coco(coco_docs(spark, d))).select("image_id", "category", *b_(("xmin", "ymax")))


@q("import_visual_genome", KN + "select i.image_id, i.filename as uri, k.category, case when k.category is not null then 2 end::int as names, x1 as xmin, yh as ymax from img i left join kn k using (image_id)")
def import_genome(spark, d):
    i = images(spark, d).select("image_id", F.col("filename").alias("url"))
    x = F.col("box")
    o = F.struct(F.col("detection_id").alias("object_id"), F.array("category", "supercategory").alias("names"), *[c.alias(n) for c, n in zip(xywh(x), "xywh")])
    objs = known(spark, d).groupBy("image_id").agg(F.collect_list(o).alias("objects"))
    g = I.visual_genome(R.read_json(spark, as_json(i, "genome-images"), I.GENOME_IMAGES), R.read_json(spark, as_json(objs, "genome-objects"), I.GENOME_OBJECTS))
    return g.select("image_id", "uri", "category", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("names"), *b_(("xmin", "ymax")))


@q("import_faces_by_file", f"with {FACE} select filename as uri, 'face' as category, xmin, ymin, xmax, ymax from f where filename is not null")
def import_faces(spark, d):
    f = faces(spark, d).where("filename is not null").groupBy("filename").agg(F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in zip(CORNERS, ("x0", "y0", "x1", "y1"))])).alias("bboxes"))
    docs = R.read_json(spark, as_json(f, "faces"), "filename string, bboxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return I.boxes_by_file(docs, "filename", "bboxes", lambda o: B.box(o["x0"], o["y0"], o["x1"], o["y1"])).select("uri", "category", *b_(CORNERS))


@q("import_xml_boxes", KN + "select 'im' || image_id as uri, category, x1 as xmin, y1 as ymin, x2 as xmax, y2 as ymax from kn")
def import_xml(spark, d):
    box = F.concat(F.lit("<bndbox>"), *[F.concat(F.lit(f"<{c}>"), F.col(f"box.{c}").cast("string"), F.lit(f"</{c}>")) for c in CORNERS], F.lit("</bndbox>"))
    o = known(spark, d).select("image_id", F.concat(F.lit("<object><name>"), "category", F.lit("</name>"), box, F.lit("</object>")).alias("o"))
    docs = o.groupBy("image_id").agg(F.array_join(F.collect_list("o"), "").alias("o"))
    line = F.concat(F.lit("<annotation><filename>im"), "image_id", F.lit("</filename>"), "o", F.lit("</annotation>"))
    return I.xml_boxes(as_lines(docs, line, "xml")).select("uri", "category", *b_(CORNERS))


# --- tables -------------------------------------------------------------------------------------


def open_images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    label = F.concat(F.lit("/m/"), F.col("category_id").cast("string")).alias("label")
    classes = as_csv(ref(spark, d).select(label.alias("id"), F.col("category").alias("name")), "classes")
    boxes = as_csv(known(spark, d).select("image_id", label, *[(F.col(f"box.{c}") / 1000).alias(c) for c in CORNERS]), "boxes")
    tags = images(spark, d).select("image_id", F.explode("confidences").alias("category", "conf")).join(F.broadcast(ref(spark, d)), "category")
    labels = as_csv(tags.select("image_id", label, "conf"), "labels")
    return I.open_images(boxes, labels, classes)


@q("import_open_images", KN + "select image_id, category, x1 / 1000 as xmin, y1 / 1000 as ymin, x2 / 1000 as xmax, y2 / 1000 as ymax, true as normalized from kn")
def import_open_images(spark, d):
    return open_images(spark, d)[0].select("image_id", "category", "normalized", *b_(CORNERS))


@q("import_image_labels", f"with {IMG} select image_id, r.category, conf from (select image_id, unnest(map_keys(confidences)) as category, unnest(map_values(confidences)) as conf from img) t join category_ref r on r.category = t.category where conf > 0")
def import_labels(spark, d):
    return open_images(spark, d)[1].select("image_id", F.explode("confidences").alias("category", "conf"))


@q("import_numbered_classes", KN + "select 'd' || detection_id as uri, k.category, k.category || ';' || k.supercategory as tags from kn k where supercategory is not null")
def import_classes(spark, d):
    fine = ref(spark, d).select(F.col("category_id").alias("label"), F.array("category").alias("tags"))
    groups = ref(spark, d).select("supercategory").distinct().select(F.xxhash64("supercategory").alias("label"), F.array("supercategory").alias("tags"))
    rows = known(spark, d).where("supercategory is not null").select(F.concat(F.lit("d"), "detection_id").alias("path"), "category_id", F.xxhash64("supercategory").alias("coarse"))
    i = I.numbered_classes(as_table(rows, "numbered"), "category_id", fine, "path", None, "coarse", groups)
    return i.select("uri", "category", F.array_join("tags", ";").alias("tags"))


@q("import_captions", f"with {IMG}, c as (select filename, list_filter(list_concat(coalesce(captions, []), [category]), lambda x: x is not null) as l from img where filename is not null and (captions is not null or category is not null)) select filename as uri, len(l) as n, l[1] as first from c")
def import_captions(spark, d):
    from framelake.operators.live import latest

    i = latest(table(spark, d, "image"), "image_id", "ingested_at", {c: F.col(c) for c in ("filename", "captions", "category")}).where("filename is not null and (captions is not null or category is not null)")
    c = I.captioned(as_table(i, "captions"), F.col("filename"), [F.col("captions"), F.col("category")])
    return c.select("uri", F.size("captions").cast("bigint").alias("n"), F.get("captions", F.lit(0)).alias("first"))


@q("import_boxed_rows", KN + "select i.filename as uri, k.category, x1 as xmin, y1 as ymin, xw as xmax, yh as ymax, len(tags) as n_tags from img i left join kn k using (image_id)")
def import_boxed(spark, d):
    o = known(spark, d).groupBy("image_id").agg(F.collect_list(F.struct("category", F.array(*xywh(F.col("box"))).alias("bbox"))).alias("objects"))
    rows = as_table(images(spark, d).select("image_id", "filename", "tags").join(o, "image_id", "left"), "boxed")
    i = I.boxed(rows, F.col("filename"), F.col("objects"), lambda o: o["category"], lambda o: B.from_xywh(*[F.get(o["bbox"], F.lit(k)) for k in range(4)]), F.col("tags"))
    return i.select("uri", "category", *b_(CORNERS), F.when(F.col("tags").isNotNull(), F.size("tags")).cast("bigint").alias("n_tags"))


@q("import_probable_labels", f"with {IMG}, t as (select image_id, unnest(map_keys(confidences)) as k, unnest(map_values(confidences)) as v from img where confidences is not null) select image_id, count(*) filter (where v > 0.5) as n from t group by 1")
def import_probable(spark, d):
    i = images(spark, d).where("size(confidences) > 0").select("image_id", F.map_keys("confidences").alias("labels"), F.map_values("confidences").alias("label_probs"))
    return I.parallel_labels(as_table(i, "probable"), "labels", "label_probs", 0.5).select("image_id", F.size("tags").cast("bigint").alias("n"))


@q("import_modalities", f"with {IMG} select a.image_id // 2 as number, a.filename as rgb, b.filename as swir from img a join img b on b.image_id = a.image_id + 1 where a.image_id % 2 = 0")
def import_modalities(spark, d):
    i = as_table(images(spark, d).select(F.floor(F.col("image_id") / 2).alias("number"), F.pmod("image_id", F.lit(2)).alias("side"), "filename"), "modalities")
    p = I.paired_modalities(i.where("side = 0").drop("side"), i.where("side = 1").drop("side"), "number")
    return p.select("number", F.col("filename").alias("rgb"), F.col("filename_2").alias("swir"))


@q("import_face_database", f"with {FACE} select face_id, 'data/flickr/' || filename as uri, xmin, ymin, xmin + (xmax - xmin) as xmax, ymin + (ymax - ymin) as ymax, xmin as left_eye_x, case when face_id % 3 <> 0 then ymax end as chin_y, 2 + (face_id % 3 <> 0)::int as n_points from f where filename is not null")
def import_face_database(spark, d):
    f = faces(spark, d).where("filename is not null")
    kinds = spark.createDataFrame([(i + 1, n) for i, n in enumerate(I.LANDMARKS)], "feature_id int, descr string")
    at = {n: i + 1 for i, n in enumerate(I.LANDMARKS)}
    marks = F.array(*[F.struct(F.lit(at[n]).alias("feature_id"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y in (("LeftEyeCenter", "xmin", "ymin"), ("RightEyeCenter", "xmax", "ymin"), ("ChinCenter", "xmin", "ymax"))])
    points = f.select("face_id", F.explode(marks).alias("m")).select("face_id", "m.*").where((F.col("feature_id") != at["ChinCenter"]) | (F.pmod("face_id", F.lit(3)) != 0))
    rects = f.select("face_id", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))
    db = [as_table(t, n) for t, n in ((f.select("face_id", F.col("face_id").alias("file_id")), "db-faces"), (f.select(F.col("face_id").alias("file_id"), F.col("filename").alias("filepath")), "db-images"), (rects, "db-rects"), (points, "db-points"), (kinds, "db-kinds"))]
    r = I.landmark_faces(*db)
    four = I.eyes_nose_chin("points")
    n = F.size(F.filter(I.landmarks("points"), lambda p: p.isNotNull()))
    return r.select("face_id", "uri", *b_(CORNERS), F.get(four, F.lit(0))["x"].alias("left_eye_x"), F.get(four, F.lit(3))["y"].alias("chin_y"), n.alias("n_points"))


@q("import_encoded_faces", f"with {FACE} select 'm' || face_id % 50 || '/' || face_id || '-0.jpg' as uri, c_name as category, filename as content from f join customer on c_custkey = face_id % 50 where filename is not null")
def import_encoded(spark, d):
    f = faces(spark, d).where("filename is not null")
    mid = F.concat(F.lit("m"), F.pmod("face_id", F.lit(50)).cast("string")).alias("mid")
    rows = as_csv(f.select(mid, F.col("face_id").cast("string").alias("rank"), F.lit("0").alias("face"), F.base64(F.col("filename").cast("binary")).alias("data")), "celebrities", "\t")
    names = as_csv(table(spark, d, "customer").where("c_custkey < 50").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("mid"), F.col("c_name").alias("name")), "celebrity-names", "\t")
    e = I.encoded_faces(rows, names).where("category is not null")
    return e.select("uri", "category", F.col("content").cast("string").alias("content"))


# --- paths and lines ----------------------------------------------------------------------------


def paths(spark: SparkSession, d: str) -> DataFrame:
    return as_lines(images(spark, d), F.col("filename"), "paths").select(F.col("value").alias("path"))


@q("import_folders", f"with {IMG} select filename as uri, {PARENT.format('filename')} as category from img where filename is not null")
def import_folders(spark, d):
    return I.by_folder(paths(spark, d)).select("uri", "category")


@q("import_name_parts", f"with {IMG} select filename as uri, string_split({TAIL.format('filename')}, '_')[2] as category from img where filename is not null")
def import_names(spark, d):
    return I.by_folder(paths(spark, d), category=I.name_part("path", 1)).select("uri", "category")


@q("import_camel_words", "select category, array_to_string(regexp_extract_all(array_to_string(list_transform(string_split(category, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), '[A-Z][a-z]*'), ' ') as words from category_ref")
def import_camel(spark, d):
    camel = F.array_join(F.transform(F.split("category", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return ref(spark, d).select("category", I.words_of(camel).alias("words"))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    return as_lines(faces(spark, d), F.col("filename"), "face-paths").select(F.col("value").alias("path"))


@q("import_synsets", f"with {FACE} select filename as uri, coalesce(i.person_name, {PARENT.format('filename')}) as category, case when i.person_name is null then 1 else 2 end::int as n from f left join face_identity i on i.wordnetid = {PARENT.format('filename')} where filename is not null")
def import_synsets(spark, d):
    who = table(spark, d, "face_identity").where("person_name is not null")
    names = I.synset_words(as_lines(who, F.concat("wordnetid", F.lit(" "), "person_name", F.lit(", person")), "synsets"))
    return I.by_synset(subjects(spark, d), names).select("uri", "category", F.size("tags").alias("n"))


@q("import_cropped_faces", f"with {FACE} select filename as uri, replace(i.person_name, ' ', '_') as category, 13.0::double as xmin, 237.0::double as ymax from f join face_identity i on i.wordnetid = {PARENT.format('filename')} where filename is not null")
def import_cropped(spark, d):
    names = as_csv(table(spark, d, "face_identity").select(F.col("wordnetid").alias("subject"), F.translate("person_name", " ", "_").alias("name")), "subjects", " ")
    return I.central_box(subjects(spark, d), names, 13.0, 237.0).select("uri", "category", *b_(("xmin", "ymax")))


@q("import_listed_files", f"with {FACE}, l as (select {TAIL.format('filename')} as name, min(face_id) as k from f where filename is not null group by 1) select f.filename as uri, 'k' || l.k as category from f join l on l.name = {TAIL.format('f.filename')} where l.k % 2 = 0")
def import_listed(spark, d):
    from framelake.functions.strings import file_tail

    f = faces(spark, d).where("filename is not null")
    labels = f.groupBy(file_tail("filename").alias("name")).agg(F.min("face_id").alias("k")).where("k % 2 = 0").select("name", F.concat(F.lit("k"), F.col("k").cast("string")).alias("category"))
    return I.by_listed_name(subjects(spark, d), as_csv(labels, "labels", " ")).select("uri", "category")


@q("import_by_position", f"with p as (select c_name as path, row_number() over (order by c_name) - 1 as n from customer) select path as uri, 'flower' || n % 102 as category from p")
def import_positions(spark, d):
    files = as_lines(table(spark, d, "customer"), F.col("c_name"), "flowers").select(F.col("value").alias("path"))
    labels = spark.range(table(spark, d, "customer").count()).select(F.col("id").alias("n"), F.concat(F.lit("flower"), F.pmod("id", F.lit(102)).cast("string")).alias("category"))
    return I.by_position(files, as_csv(labels, "flower-labels")).select("uri", "category")


@q("import_label_lines", KN + "select 'im' || image_id as uri, replace(category, ' ', '_') as category, x1 as xmin, y1 as ymin, x2 as xmax, y2 as ymax from kn")
def import_label_lines(spark, d):
    line = F.concat_ws(" ", F.concat(F.lit("im"), "image_id"), F.translate("category", " ", "_"), F.lit("0.00 0 -1.5"), *[F.col(f"box.{c}").cast("string") for c in CORNERS], F.lit("1.5 1.6 3.7 1 2 30 0.1"))
    c = as_lines(known(spark, d), line, "kitti").select(F.split("value", " ").alias("c"))
    return I.cell_boxes(c, F.get("c", F.lit(0)), F.col("c"), 5, F.get("c", F.lit(1))).select("uri", "category", *b_(CORNERS))


def block_texts(spark: SparkSession, d: str, cells: list[Column], name: str) -> DataFrame:
    o = known(spark, d).select("image_id", F.concat_ws(" ", *[c.cast("string") for c in cells]).alias("l"))
    per = o.groupBy("image_id").agg(F.collect_list("l").alias("l"))
    text = F.concat(F.lit("2002/im"), F.col("image_id").cast("string"), F.lit("\n"), F.size("l").cast("string"), F.lit("\n"), F.array_join("l", "\n"), F.lit("\n"))
    docs = per.groupBy(F.floor(F.col("image_id") / 100).alias("part")).agg(F.array_join(F.collect_list(text), "").alias("t"))
    return as_lines(docs, F.col("t"), name, sep="\u0001")


@q("import_block_boxes", KN + "select '2002/im' || image_id as uri, x1 as xmin, y1 as ymin, xw as xmax, yh as ymax from kn")
def import_blocks(spark, d):
    return I.block_boxes(block_texts(spark, d, xywh(F.col("box")), "wider")).select("uri", *b_(CORNERS))


@q("import_ellipses", KN + "select '2002/im' || image_id || '.jpg' as uri, 'face' as category, round((x1 + x2) / 2 - w / 2, 6) as xmin, round((y1 + y2) / 2 + h / 2, 6) as ymax from kn")
def import_ellipses(spark, d):
    x = F.col("box")
    cells = [B.height(x) / 2, B.width(x) / 2, F.lit("1.2"), (x["xmin"] + x["xmax"]) / 2, (x["ymin"] + x["ymax"]) / 2, F.lit("1")]
    i = I.ellipse_boxes(block_texts(spark, d, cells, "ellipses"))
    return i.select("uri", "category", F.round("box.xmin", 6).alias("xmin"), F.round("box.ymax", 6).alias("ymax"))


@q("import_named_boxes", f"with {FACE} select 'u' || face_id as uri, 'Person_' || face_id % 40 as category, xmin, ymin, xmax, ymax from f")
def import_named(spark, d):
    f = faces(spark, d).select(F.concat(F.lit("Person "), F.pmod("face_id", F.lit(40)).cast("string")).alias("name"), "face_id", F.concat(F.lit("u"), F.col("face_id").cast("string")).alias("url"), F.concat_ws(",", *[F.col(c).cast("string") for c in CORNERS]).alias("bbox"), F.lit("ab12").alias("sha256"))
    rows = as_csv(f, "named", "\t", header=True)
    return I.cell_boxes(rows, F.col("url"), F.split("bbox", ","), 0, F.translate("name", " ", "_")).select("uri", "category", *b_(CORNERS))


@q("import_center_boxes", f"with {FACE}, g as (select *, floor(xmin) as x, floor(ymin) as y, floor(xmax - xmin) as w, floor(ymax - ymin) as h from f) select 'P/1/' || face_id as uri, x - floor(w / 2) as xmin, y - floor(h / 2) as ymin, x - floor(w / 2) + w as xmax, y - floor(h / 2) + h as ymax from g")
def import_centers(spark, d):
    whole = lambda c: F.floor(c).cast("string")
    line = F.concat_ws(",", F.concat(F.lit("P\\1\\"), "face_id"), F.lit("0"), whole(F.col("xmin")), whole(F.col("ymin")), whole(F.col("xmax") - F.col("xmin")), whole(F.col("ymax") - F.col("ymin")), F.lit("0.0"), F.lit("1"))
    c = as_lines(faces(spark, d), line, "labeled").select(F.split("value", ",").alias("c"))
    name = F.translate(F.get("c", F.lit(0)), "\\", "/")
    return I.center_boxes(c, name, F.col("c"), 2, F.get(F.split(name, "/"), F.lit(0))).select("uri", *b_(CORNERS))


@q("import_face_pairs", "select 'lfw/' || c_name || '/' || c_name || '_' || lpad((c_custkey % 30)::varchar, 4, '0') || '.jpg' as uri_a, case when c_custkey % 2 = 0 then 'lfw/' || c_name || '/' || c_name else 'lfw/X/X' end || '_' || lpad((c_custkey % 7)::varchar, 4, '0') || '.jpg' as uri_b, c_custkey % 2 = 0 as same from customer")
def import_pairs(spark, d):
    k = F.col("c_custkey")
    cell = lambda m: F.pmod(k, F.lit(m)).cast("string")
    line = F.when(k % 2 == 0, F.concat_ws("\t", "c_name", cell(30), cell(7))).otherwise(F.concat_ws("\t", F.col("c_name"), cell(30), F.lit("X"), cell(7)))
    return I.same_or_not(as_lines(table(spark, d, "customer"), line, "pairs"), "lfw")


# --- videos -------------------------------------------------------------------------------------

_K = f"with {KEY} "
_A = f"with {ACT}, ka as (select a.*, r.category_id from act a join category_ref r on r.category = a.category) "


def person_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = keyboxes(spark, d)
    rows = k.select("video_id", F.col("frame").alias("middle_sec"), *[F.col(f"box.{c}").alias(c) for c in CORNERS], (F.pmod("track_id", F.lit(3)) + 1).alias("action_id"), F.col("track_id").alias("person_id"))
    actions = spark.createDataFrame([(1, "stand"), (2, "walk"), (3, "talk to")], "action_id bigint, category string")
    return I.ava(as_csv(rows, "ava"), as_csv(actions, "ava-actions"))


@q("import_person_tracks", _K + "select video_id, track_id, frame * 30 as frame, x1 as xmin, y2 as ymax from kb")
def import_persons(spark, d):
    return person_rows(spark, d)[0].select("video_id", "track_id", "frame", *b_(("xmin", "ymax")))


@q("import_person_actions", _K + "select video_id, case track_id % 3 when 0 then 'stand' when 1 then 'walk' else 'talk to' end as category, frame * 30 - 45 as startframe, frame * 30 + 45 as endframe, track_id from kb")
def import_actions(spark, d):
    return person_rows(spark, d)[1].select("video_id", "category", "startframe", "endframe", F.get("track_ids", F.lit(0)).alias("track_id"))


@q("import_timed_objects", _K + "select 'v' || video_id as video_id, 'kind' || track_id % 3 || ':' || track_id as track_id, 'kind' || track_id % 3 as category, cast(floor(frame * 33 * 30.0 / 1000) as int) as frame, x1 as xmin, y2 as ymax from kb where frame % 7 <> 0")
def import_timed(spark, d):
    gone = F.pmod("frame", F.lit(7)) == 0
    at = lambda c: F.when(gone, -1.0).otherwise(F.col(f"box.{c}")).alias(c)
    rows = keyboxes(spark, d).select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("youtube_id"), (F.col("frame") * 33).alias("timestamp_ms"), F.concat(F.lit("kind"), F.pmod("track_id", F.lit(3)).cast("string")).alias("class_name"), F.col("track_id").alias("object_id"), F.when(gone, "absent").otherwise("present").alias("presence"), *[at(c) for c in CORNERS])
    return I.youtube_boxes(as_csv(rows, "timed")).select("video_id", "track_id", "category", "frame", *b_(("xmin", "ymax")))


def known_acts(spark: SparkSession, d: str) -> DataFrame:
    return acts(spark, d).join(F.broadcast(ref(spark, d).select("category_id", "category")), "category")


def seconds() -> Column:
    return F.array(F.col("startframe") / 30.0, F.col("endframe") / 30.0)


@q("import_segments", _A + "select 'v' || video_id as video_id, category, cast(round_even(startframe / 30.0::double * 30, 0) as int) as startframe, cast(round_even(endframe / 30.0::double * 30, 0) as int) as endframe from ka where video_id % 2 = 0")
def import_segments(spark, d):
    per = known_acts(spark, d).groupBy("video_id").agg(F.collect_list(F.struct(F.col("category").alias("label"), seconds().alias("segment"))).alias("annotations"))
    subset = F.when(F.col("video_id") % 2 == 0, "training").otherwise("validation")
    doc = per.select(F.create_map(F.concat(F.lit("v"), F.col("video_id").cast("string")), F.struct(F.lit("u").alias("url"), subset.alias("subset"), "annotations")).alias("database"))
    docs = R.read_json(spark, as_json(doc, "segments"), f"database {I.ACTIVITYNET}")
    return I.segments(docs, "training").select("video_id", "category", "startframe", "endframe")


@q("import_clips", _A + "select 'u' || activity_id as uri, category, startframe / 30.0::double as startsec, endframe / 30.0::double as endsec, case when activity_id % 10 = 0 then 'test' else 'train' end as split from ka")
def import_clips(spark, d):
    body = F.struct(F.concat(F.lit("u"), F.col("activity_id").cast("string")).alias("url"), F.when(F.col("activity_id") % 10 == 0, "test").otherwise("train").alias("subset"), F.struct(F.col("category").alias("label"), seconds().alias("segment")).alias("annotations"))
    lines = as_lines(known_acts(spark, d), F.to_json(F.create_map(F.col("activity_id").cast("string"), body)), "clips")
    return I.labelled_clips(lines).select("uri", "category", "startsec", "endsec", "split")


@q("import_action_lists", _A + "select 'v' || video_id as video_id, category, cast(round_even(startframe / 30.0::double * 30, 0) as int) as startframe, cast(round_even(endframe / 30.0::double * 30, 0) as int) as endframe from ka")
def import_action_lists(spark, d):
    code = F.concat(F.lit("c"), F.lpad(F.col("category_id").cast("string"), 3, "0"))
    one = F.concat_ws(" ", code, (F.col("startframe") / 30.0).cast("string"), (F.col("endframe") / 30.0).cast("string"))
    rows = known_acts(spark, d).groupBy("video_id").agg(F.array_join(F.collect_list(one), ";").alias("actions"))
    rows = as_csv(rows.select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("id"), F.lit("Kitchen").alias("scene"), "actions"), "charades", header=True)
    classes = as_lines(ref(spark, d), F.concat(code, F.lit(" "), "category"), "charades-classes")
    return I.charades(rows, classes, 30.0).select("video_id", "category", "startframe", "endframe")


@q("import_many_labels", _A + "select distinct 'v' || video_id as video_id, category, 0 as startframe, 90 as endframe from ka")
def import_many_labels(spark, d):
    rows = known_acts(spark, d).groupBy("video_id").agg(F.collect_set("category_id").alias("c"))
    lines = as_lines(rows, F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit(","), F.array_join(F.col("c").cast("array<string>"), ",")), "moments")
    names = as_lines(ref(spark, d), F.concat("category", F.lit(","), F.col("category_id").cast("string")), "moments-names")
    return I.moments(lines, names)


@q("import_tagged_videos", _A + ", t as (select video_id, list_sort(list(distinct category)) as l from ka group by 1) select 'videos/train/v' || video_id as uri, l[1] as category, len(l) as n, 'train' as split from t")
def import_tagged(spark, d):
    rows = known_acts(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_set("category")).alias("label"))
    docs = R.read_json(spark, as_json(rows.select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("path"), "label"), "tagged"), "path string, label array<string>")
    return I.tagged_videos(docs, "videos", "train").select("uri", "category", F.size("tags").cast("bigint").alias("n"), "split")


def meva_lines(spark: SparkSession, d: str) -> DataFrame:
    k = keyboxes(spark, d).withColumn("video", F.concat(F.lit("m"), F.col("video_id").cast("string")))
    whole = F.concat_ws(" ", *[F.floor(F.col(f"box.{c}")).cast("string") for c in CORNERS])
    t = k.select("video", "track_id").distinct().select("video", F.format_string("- { types: { id1: %d, cset3: { %s: 1.0 } } }", "track_id", F.when(F.col("track_id") % 2 == 0, "Person").otherwise("Vehicle")).alias("value"))
    g = k.select("video", F.format_string("- { geom: { id1: %d, id0: 1, ts0: %d, g0: %s, keyframe: 1 } }", "track_id", "frame", whole).alias("value"))
    a = event_acts(spark, d).select(F.concat(F.lit("m"), F.col("video_id").cast("string")).alias("video"), F.format_string("- { act: { act2: { person_%s: 1.0 }, id2: 7, timespan: [{ tsr0: [%d, %d] }], src_status: x, actors: [{ id1: %d, timespan: [{ tsr0: [1, 2] }] }, { id1: 999999, timespan: [{ tsr0: [1, 2] }] }] } }", "category", "startframe", "endframe", F.get("track_ids", F.lit(0))).alias("value"))
    return as_table(t.unionByName(g).unionByName(a), "meva")


@q("import_yaml_tracks", _K + "select 'm' || video_id as video_id, track_id, case when track_id % 2 = 0 then 'Person' else 'Vehicle' end as category, frame, floor(x1) as xmin, floor(y2) as ymax from kb")
def import_yaml_tracks(spark, d):
    return I.meva(meva_lines(spark, d))[0].select("video_id", "track_id", "category", "frame", *b_(("xmin", "ymax")))


@q("import_yaml_activities", f"with {KEY}, {EACT} select 'm' || video_id as video_id, 'person_' || category as category, startframe, endframe, track_id from ea where track_id in (select track_id from kb)")
def import_yaml_activities(spark, d):
    return I.meva(meva_lines(spark, d))[1].select("video_id", "category", "startframe", "endframe", F.get("track_ids", F.lit(0)).alias("track_id"))


def scene_archive(spark: SparkSession, d: str) -> DataFrame:
    """One scene a track, as serialized objects with normal field names."""
    k = keyboxes(spark, d)
    det = R.detection_json(F.col("frame"), F.lit("thing"), F.col("conf"), F.col("box"))
    t = k.groupBy("video_id", "track_id").agg(F.collect_list(F.struct("frame", det.alias("d"))).alias("k"))
    track = F.struct(F.col("track_id").cast("string").alias("id"), F.lit("thing").alias("label"), F.lit(30.0).alias("framerate"), F.col("k.frame").alias("keyframes"), F.col("k.d").alias("keyboxes"))
    a = event_acts(spark, d).select("video_id", F.get("track_ids", F.lit(0)).alias("track_id"), F.struct(F.col("activity_id").cast("string").alias("id"), F.col("category").alias("label"), "startframe", "endframe", F.lit(30.0).alias("framerate"), F.transform("track_ids", lambda x: x.cast("string")).alias("trackid")).alias("a"))
    a = a.groupBy("video_id", "track_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("a.id"), F.col("a")))).alias("activities"))
    s = t.join(a, ["video_id", "track_id"], "left")
    scene = F.struct(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("filename"), F.create_map(F.col("track_id").cast("string"), track).alias("tracks"), "activities")
    lines = as_lines(s, R.to_envelope(scene, "Scene"), "scenes")
    return R.unwrap(lines, "value", "Scene").withColumn("v", F.col("payload.filename"))


@q("import_scene_tracks", _K + "select 'v' || video_id as video_id, track_id::varchar as track_id, 'thing' as category, frame, conf, x1 as xmin, y2 as ymax from kb")
def import_scene_tracks(spark, d):
    return R.scene_keyboxes(scene_archive(spark, d), "v").select("video_id", "track_id", "category", "frame", "conf", *b_(("xmin", "ymax")))


@q("import_scene_activities", f"with {KEY}, {EACT} select 'v' || video_id as video_id, activity_id::varchar as activity_id, category, startframe, endframe, track_id::varchar as track_id from ea")
def import_scene_activities(spark, d):
    a = R.scene_activities(scene_archive(spark, d), "v")
    return a.select("video_id", "activity_id", "category", "startframe", "endframe", F.get("track_ids", F.lit(0)).alias("track_id"))


QUERIES, ORACLES = Q, O
