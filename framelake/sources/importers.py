"""Recipes that turn published annotation layouts into canonical rows.

A recipe takes frames (parsed documents, rows of a table, paths of files) and gives frames:
images: uri, category, tags, captions, box, attributes, split; clips: uri, category, startframe,
endframe, startsec, endsec; track boxes: video_id, track_id, category, frame, box; activities:
video_id, category, startframe, endframe. What a layout does not state is null. Downloads are outside.
`sets` binds the recipes to the files of each published set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions.strings import file_tail, parent
from framelake.operators.joins import with_dimension
from framelake.sources import readers as R

IMAGE = {"uri": "string", "category": "string", "tags": "array<string>", "captions": "array<string>", "box": R.BOX, "attributes": "map<string,string>", "split": "string"}
CLIP = {"uri": "string", "category": "string", "startframe": "int", "endframe": "int", "startsec": "double", "endsec": "double", "split": "string"}


def _rows(df: DataFrame, kinds: dict[str, str], cols: dict[str, Column]) -> DataFrame:
    return df.select(*[cols.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def image_rows(df: DataFrame, **cols: Column) -> DataFrame:
    """Canonical image rows of the given columns; the others are null."""
    return _rows(df, IMAGE, cols)


def clip_rows(df: DataFrame, **cols: Column) -> DataFrame:
    """Canonical clips of the given columns; the others are null."""
    return _rows(df, CLIP, cols)


def trimmed_list(text: Column, sep: str = ",") -> Column:
    """Names in a text, without the blanks around them."""
    return F.transform(F.split(text, sep), lambda x: F.trim(x))


def corners(cells: Column, at: int = 0) -> Column:
    """Box of four numbers in a list of texts from place `at` on: xmin, ymin, xmax, ymax."""
    return B.box(*[F.get(cells, F.lit(at + i)).try_cast("double") for i in range(4)])


def extent(cells: Column, at: int = 0) -> Column:
    """Box of four numbers in a list of texts from place `at` on: xmin, ymin, width, height."""
    return B.from_xywh(*[F.get(cells, F.lit(at + i)).try_cast("double") for i in range(4)])


# --- documents ----------------------------------------------------------------------------------

COCO = "images array<struct<id:bigint,file_name:string,coco_url:string>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,score:double>>, categories array<struct<id:bigint,name:string,synonyms:array<string>>>"


def coco(docs: DataFrame) -> DataFrame:
    """image_id, uri, category, synonyms, conf, box of documents of images, annotations (x, y, w, h) and
    categories; images without objects stay. Repeats of a category over documents count once."""
    image = docs.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.coalesce("i.file_name", "i.coco_url").alias("uri"))
    cat = docs.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"), F.col("c.synonyms").alias("synonyms")).dropDuplicates(["category_id"])
    a = docs.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", F.col("a.score").alias("conf"), F.col("a.bbox").alias("b"))
    a = a.select("image_id", "category_id", "conf", F.when(F.size("b") >= 4, B.from_xywh(*[F.get("b", F.lit(i)) for i in range(4)])).alias("box"))
    return image.join(with_dimension(a, cat, ["category_id"], "inner"), "image_id", "left")


def one_label(objects: DataFrame) -> DataFrame:
    """One row an image with the category of its annotation; of several, the first in order of names."""
    return objects.groupBy("image_id", "uri").agg(F.min("category").alias("category"))


def as_classification(objects: DataFrame) -> DataFrame:
    """One row an object, its category the row's."""
    return objects.where("category is not null").select("image_id", "category", "box")


GENOME_IMAGES = "image_id bigint, url string"
GENOME_OBJECTS = "image_id bigint, objects array<struct<object_id:bigint,names:array<string>,x:double,y:double,w:double,h:double,synsets:array<string>>>"


def visual_genome(images: DataFrame, objects: DataFrame) -> DataFrame:
    """image_id, uri, category, tags, box; all names of an object are its tags, the first its category."""
    e = objects.select("image_id", F.explode("objects").alias("o"))
    e = e.select("image_id", F.get("o.names", F.lit(0)).alias("category"), F.col("o.names").alias("tags"), B.from_xywh(F.col("o.x"), F.col("o.y"), F.col("o.w"), F.col("o.h")).alias("box"))
    return images.select("image_id", F.col("url").alias("uri")).join(e, "image_id", "left")


def boxes_by_file(docs: DataFrame, name: str, boxes: str, to_box: Callable[[Column], Column], category: str = "face") -> DataFrame:
    """One row a box of documents that list a file's boxes of one category."""
    e = docs.select(F.col(name).alias("name"), F.explode(boxes).alias("o"))
    return image_rows(e, uri=F.col("name"), category=F.lit(category), box=to_box(F.col("o")))


VOC_XML = "struct<filename:string,folder:string,object:array<struct<name:string,subcategory:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>"


def xml_boxes(docs: DataFrame, text: str = "value", uri: Column | None = None) -> DataFrame:
    """One row an object of XML annotations (one document a row): file name, name of the class and box."""
    d = docs.select(F.from_xml(F.col(text), VOC_XML).alias("d"), (uri if uri is not None else F.lit(None)).cast("string").alias("uri"))
    e = d.select(F.coalesce("uri", "d.filename").alias("uri"), F.explode("d.object").alias("o"))
    b = F.col("o.bndbox")
    return image_rows(e, uri=F.col("uri"), category=F.col("o.name"), box=B.box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), attributes=F.when(F.col("o.subcategory").isNotNull(), F.create_map(F.lit("subcategory"), F.col("o.subcategory"))))


# --- videos and activities ----------------------------------------------------------------------

ACTIVITYNET = "map<string,struct<url:string,subset:string,annotations:array<struct<label:string,segment:array<double>>>>>"
KINETICS = "map<string,struct<url:string,subset:string,annotations:struct<label:string,segment:array<double>>>>"


def _seconds_to_frames(seconds: Column, fps: float) -> Column:
    return F.rint(seconds * fps).cast("int")


def segments(docs: DataFrame, subset: str | None = None, fps: float = 30.0) -> DataFrame:
    """Activities of documents {"database": {id: {url, subset, annotations: [{label, segment: [s, e]}]}}}."""
    e = docs.select(F.explode("database").alias("video_id", "v"))
    if subset:
        e = e.where(F.col("v.subset") == subset)
    a = e.select("video_id", F.col("v.url").alias("uri"), F.explode("v.annotations").alias("a"))
    frame = lambda i: _seconds_to_frames(F.get("a.segment", F.lit(i)), fps)
    return a.select("video_id", "uri", F.col("a.label").alias("category"), frame(0).alias("startframe"), frame(1).alias("endframe"))


def labelled_clips(docs: DataFrame, text: str = "value") -> DataFrame:
    """Clips of documents {id: {url, annotations: {label, segment: [s, e]}}}: one label a clip."""
    e = docs.select(F.explode(F.from_json(text, KINETICS)).alias("video_id", "v"))
    seg = F.col("v.annotations.segment")
    return clip_rows(e, uri=F.coalesce(F.col("v.url"), F.col("video_id")), category=F.col("v.annotations.label"), startsec=F.get(seg, F.lit(0)), endsec=F.get(seg, F.lit(1)), split=F.col("v.subset"))


def ava(rows: DataFrame, actions: DataFrame, fps: float = 30.0, reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Person boxes by time as tracks, and each action as an activity of +-1.5 s about its time."""
    f = _seconds_to_frames(F.col("middle_sec"), fps)
    keys = rows.select("video_id", F.col("person_id").alias("track_id"), f.alias("frame"), B.box("xmin", "ymin", "xmax", "ymax").alias("box")).distinct()
    acts = with_dimension(rows, actions, ["action_id"], "inner")
    acts = acts.select("video_id", "category", _seconds_to_frames(F.col("middle_sec") - reach, fps).alias("startframe"), _seconds_to_frames(F.col("middle_sec") + reach, fps).alias("endframe"), F.array("person_id").alias("track_ids"))
    return keys, acts


def youtube_boxes(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Tracks of (video, object); absent boxes (-1) are left out, milliseconds become frames by truncation."""
    ok = rows.where((F.col("presence") != "absent") & (F.col("xmin") >= 0))
    frame = F.floor(F.col("timestamp_ms") * fps / 1000).cast("int")
    track = F.concat_ws(":", "class_name", F.col("object_id").cast("string"))
    return ok.select(F.col("youtube_id").alias("video_id"), track.alias("track_id"), F.col("class_name").alias("category"), frame.alias("frame"), B.box("xmin", "ymin", "xmax", "ymax").alias("box"))


def charades(rows: DataFrame, classes: DataFrame, fps: Column | float) -> DataFrame:
    """Activities of rows (id, scene, actions): actions are 'class start end' in seconds, parted by ';'.

    classes: value, 'class name of the activity'. Actions of another form are left out."""
    names = classes.select(F.regexp_extract("value", r"^(\S+)\s+(.*?)\s*$", 1).alias("code"), F.regexp_extract("value", r"^(\S+)\s+(.*?)\s*$", 2).alias("category"))
    a = rows.select(F.col("id").alias("video_id"), "scene", (fps if isinstance(fps, Column) else F.lit(fps)).alias("fps"), F.explode(F.split("actions", ";")).alias("a"))
    p = F.split("a", " ")
    a = a.select("video_id", "scene", "fps", F.get(p, F.lit(0)).alias("code"), F.get(p, F.lit(1)).try_cast("double").alias("s"), F.get(p, F.lit(2)).try_cast("double").alias("e"))
    a = with_dimension(a.where("s is not null and e is not null"), names, ["code"], "inner")
    return a.select("video_id", "scene", "category", F.rint(F.col("s") * F.col("fps")).cast("int").alias("startframe"), F.rint(F.col("e") * F.col("fps")).cast("int").alias("endframe"))


def moments(lines: DataFrame, categories: DataFrame, length: int = 90) -> DataFrame:
    """Activities of lines 'file,code,code,...': each lasts the whole clip. categories: lines 'name,code'."""
    c = F.split("value", ",")
    names = categories.select(F.get(c, F.lit(1)).cast("int").alias("code"), F.get(c, F.lit(0)).alias("category"))
    e = lines.select(F.get(c, F.lit(0)).alias("video_id"), F.explode(F.slice(c, F.lit(2), F.size(c))).alias("x")).select("video_id", F.col("x").try_cast("int").alias("code"))
    return with_dimension(e, names, ["code"], "inner").select("video_id", "category", F.lit(0).alias("startframe"), F.lit(length).alias("endframe"))


def tagged_videos(docs: DataFrame, folder: str, split: str) -> DataFrame:
    """One row a video of records (path, label: list of names); without labels in a held-out set."""
    tags = F.col("label") if "label" in docs.columns else F.lit(None)
    return image_rows(docs, uri=F.concat(F.lit(f"{folder}/{split}/"), "path"), tags=tags, category=F.get(tags.cast("array<string>"), F.lit(0)), split=F.lit(split))


def _yaml(col: str, key: str, pattern: str) -> Column:
    return F.regexp_extract(col, rf"\b{key}\s*:\s*{pattern}", 1)


def meva(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track boxes, activities) of flow-style YAML lines (video, value) of types, geometry and activities:

    types: {id1: 3, cset3: {Person: 1.0}}; geom: {id1: 3, ts0: 12, g0: 1 2 3 4}; act: {act2: {name: 1.0},
    timespan: [{tsr0: [s, e]}], actors: [{id1: 3}, ...]}. Boxes with ends out of order are left out, as
    are activities none of whose actors has a box."""
    of = lambda kind: lines.where(F.col("value").rlike(rf"^\s*-\s*\{{\s*{kind}\s*:"))
    kind = of("types").select("video", _yaml("value", "id1", r"(\d+)").cast("bigint").alias("track_id"), _yaml("value", r"cset3", r"\{\s*'?\"?([^:'\"}]+)").alias("category"))
    cells = F.split(F.trim(_yaml("value", "g0", r"['\"]?([\d.\- ]+)")), " +")
    boxes = of("geom").select("video", _yaml("value", "id1", r"(\d+)").cast("bigint").alias("track_id"), _yaml("value", "ts0", r"(\d+)").cast("int").alias("frame"), corners(cells).alias("box"))
    boxes = boxes.where(B.valid(F.col("box"))).join(kind, ["video", "track_id"], "left").select(F.col("video").alias("video_id"), "track_id", "category", "frame", "box")
    span = r"\[\s*\{[^\]]*?tsr0\s*:\s*\[\s*"
    acts = of("act").select(
        F.col("video").alias("video_id"), F.monotonically_increasing_id().alias("act"), F.regexp_extract("value", r"act[23]\s*:\s*\{\s*'?\"?([^:,'\"}]+)", 1).alias("category"),
        _yaml("value", "timespan", span + r"(\d+)").cast("int").alias("startframe"), _yaml("value", "timespan", span + r"\d+\s*,\s*(\d+)").cast("int").alias("endframe"),
        F.transform(F.regexp_extract_all(F.regexp_extract("value", r"actors\s*:\s*\[(.*)", 1), F.lit(r"id1\s*:\s*(\d+)"), 1), lambda x: x.cast("bigint")).alias("track_ids"),
    )
    known = boxes.select("video_id", F.col("track_id").alias("id")).distinct()
    actors = acts.select("video_id", "act", F.explode("track_ids").alias("id")).join(known, ["video_id", "id"]).groupBy("video_id", "act").agg(F.array_sort(F.collect_set("id")).alias("found"))
    acts = acts.join(actors, ["video_id", "act"]).select("video_id", "category", "startframe", "endframe", F.col("found").alias("track_ids"))
    return boxes, acts


# --- tables -------------------------------------------------------------------------------------


def open_images(boxes: DataFrame, labels: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized boxes with class names, and image-level tags with confidence above 0 and a boxable class."""
    c = classes.select(F.col("id").alias("label"), F.col("name").alias("category"))
    b = with_dimension(boxes, c, ["label"], "inner").select("image_id", "category", B.box("xmin", "ymin", "xmax", "ymax").alias("box"), F.lit(True).alias("normalized"))
    t = with_dimension(labels.where("conf > 0"), c, ["label"], "inner").groupBy("image_id").agg(F.map_from_entries(F.collect_set(F.struct("category", "conf"))).alias("confidences"))
    return b, t


def numbered_classes(rows: DataFrame, label: str, names: DataFrame, uri: str, split: str | None = None, also: str | None = None, also_names: DataFrame | None = None) -> DataFrame:
    """Images of a table with class numbers. names: label, tags (the first is the category); `also` is a
    second, coarser class whose names become tags."""
    n = names.select(F.col("label").alias("_label"), F.col("tags").alias("_tags"))
    j = with_dimension(rows.withColumn("_label", F.col(label)), n, ["_label"], "left")
    tags = F.col("_tags")
    if also is not None:
        m = also_names.select(F.col("label").alias("_also"), F.col("tags").alias("_also_tags"))
        j = with_dimension(j.withColumn("_also", F.col(also)), m, ["_also"], "left")
        tags = F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce("_also_tags", F.array().cast("array<string>")))
    return image_rows(j, uri=F.col(uri), category=F.get("_tags", F.lit(0)), tags=tags, split=F.lit(split))


def captioned(rows: DataFrame, url: Column, captions: list[Column], split: str | None = None) -> DataFrame:
    """Images of a table with an address and captions (a text or a list of texts each); nulls are left out."""
    kinds = {f.name: f.dataType.typeName() for f in rows.select(*[c.alias(str(i)) for i, c in enumerate(captions)]).schema.fields}
    lists = [c if kinds[str(i)] == "array" else F.array(c) for i, c in enumerate(captions)]
    return image_rows(rows, uri=url, captions=F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), split=F.lit(split))


def boxed(rows: DataFrame, uri: Column, objects: Column, category: Callable[[Column], Column], to_box: Callable[[Column], Column], tags: Column | None = None, split: str | None = None) -> DataFrame:
    """One row an object of a table whose rows list objects; rows without objects stay, with a null box."""
    e = rows.select(uri.alias("uri"), (tags if tags is not None else F.lit(None)).cast("array<string>").alias("tags"), F.explode_outer(objects).alias("o"))
    has = F.col("o").isNotNull()
    return image_rows(e, uri=F.col("uri"), tags=F.col("tags"), category=F.when(has, category(F.col("o"))), box=F.when(has, to_box(F.col("o"))), split=F.lit(split))


def parallel_labels(rows: DataFrame, labels: str, probs: str, threshold: float) -> DataFrame:
    """Tags whose probability exceeds the threshold, from two parallel lists."""
    both = F.arrays_zip(F.col(labels).alias("l"), F.col(probs).alias("p"))
    keep = F.filter(both, lambda x: x["p"] > threshold)
    return rows.withColumn("tags", F.transform(keep, lambda x: x["l"]))


def paired_modalities(a: DataFrame, b: DataFrame, number: str) -> DataFrame:
    """Two recordings of a scene side by side, by their number."""
    return a.join(b.select(number, *[F.col(c).alias(c + "_2") for c in b.columns if c != number]), number)


def landmark_faces(faces: DataFrame, images: DataFrame, rects: DataFrame, points: DataFrame, kinds: DataFrame) -> DataFrame:
    """Faces of a database of five tables: uri, box (x, y, w, h), and `points`: map from the landmark's name to its place."""
    p = with_dimension(points, kinds, ["feature_id"], "inner").groupBy("face_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("descr", F.struct("x", "y"))))).alias("points"))
    j = faces.join(images, "file_id").join(rects, "face_id").join(p, "face_id", "left")
    return j.select("face_id", F.concat(F.lit("data/flickr/"), "filepath").alias("uri"), F.lit("face").alias("category"), B.from_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), "points")


def encoded_faces(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Faces of rows (mid, rank, face, data in base64) with the person's name: uri, category, content. names: mid, name."""
    j = with_dimension(rows, names, ["mid"], "left")
    return j.select(F.concat("mid", F.lit("/"), "rank", F.lit("-"), "face", F.lit(".jpg")).alias("uri"), F.col("name").alias("category"), F.unbase64("data").alias("content"))


#: Landmarks of a face in order (fixed values).
LANDMARKS = [
    "LeftBrowLeftCorner", "LeftBrowCenter", "LeftBrowRightCorner", "RightBrowLeftCorner", "RightBrowCenter", "RightBrowRightCorner", "LeftEyeLeftCorner", "LeftEyeCenter", "LeftEyeRightCorner", "RightEyeLeftCorner", "RightEyeCenter",
    "RightEyeRightCorner", "LeftEar", "NoseLeft", "NoseCenter", "NoseRight", "RightEar", "MouthLeftCorner", "MouthCenter", "MouthRightCorner", "ChinCenter",
]


def landmarks(points: Column | str, names: list[str] = LANDMARKS) -> Column:
    """The landmarks of a face in order as (x, y); null where one is hidden."""
    p = F.col(points) if isinstance(points, str) else points
    return F.array(*[F.try_element_at(p, F.lit(n)) for n in names])


def eyes_nose_chin(points: Column | str) -> Column:
    return landmarks(points, ["LeftEyeCenter", "RightEyeCenter", "NoseCenter", "ChinCenter"])


# --- paths and lines ----------------------------------------------------------------------------


def by_folder(files: DataFrame, path: str = "path", category: Column | None = None, split: str | None = None) -> DataFrame:
    """Files whose category is the name of their folder, or what `category` makes of the path."""
    return image_rows(files, uri=F.col(path), category=category if category is not None else parent(path), split=F.lit(split))


def name_part(path: str, n: int, sep: str = "_") -> Column:
    """The n-th part of a file's name."""
    return F.get(F.split(file_tail(path), sep), F.lit(n))


def words_of(camel: Column) -> Column:
    """'ApplyEyeMakeup' as 'Apply Eye Makeup'."""
    return F.array_join(F.regexp_extract_all(camel, F.lit(r"([A-Z][a-z]*)"), 1), " ")


def by_synset(files: DataFrame, names: DataFrame, path: str = "path", split: str | None = None) -> DataFrame:
    """Files in folders named by a synset; its names become the tags. names: synset, tags."""
    j = with_dimension(files.withColumn("synset", parent(path)), names, ["synset"], "left")
    return image_rows(j, uri=F.col(path), category=F.coalesce(F.get("tags", F.lit(0)), F.col("synset")), tags=F.coalesce("tags", F.array("synset")), attributes=F.create_map(F.lit("wordnet_id"), F.col("synset")), split=F.lit(split))


def synset_words(lines: DataFrame) -> DataFrame:
    """synset, tags of lines 'n01440764 tench, Tinca tinca'."""
    form = r"^(\S+)\s+(.*)$"
    return lines.select(F.regexp_extract("value", form, 1).alias("synset"), trimmed_list(F.regexp_extract("value", form, 2)).alias("tags")).where("synset <> ''")


def by_position(files: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Files in order of their paths beside the labels in order of their lines (n, category)."""
    from framelake.operators.collection import POS, Collection

    f = Collection.of(files.select(path), [path], "files").df
    return image_rows(f.join(labels.withColumnRenamed("n", POS), POS), uri=F.col(path), category=F.col("category"))


def by_listed_name(files: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Files that a list (name, category) names; the others are left out."""
    j = with_dimension(files.withColumn("name", file_tail(path)), labels, ["name"], "inner")
    return image_rows(j, uri=F.col(path), category=F.col("category"))


def central_box(files: DataFrame, names: DataFrame, lo: float, hi: float, path: str = "path") -> DataFrame:
    """Cropped faces in folders named by a subject's number: its name, and the box that the crop leaves."""
    j = with_dimension(files.withColumn("subject", parent(path)), names, ["subject"], "inner")
    return image_rows(j, uri=F.col(path), category=F.col("name"), box=B.box(F.lit(lo), F.lit(lo), F.lit(hi), F.lit(hi)))


def cell_boxes(rows: DataFrame, uri: Column, cells: Column, at: int, category: Column, wide: bool = False, split: str | None = None) -> DataFrame:
    """One box a row from cells of text: corners, or with `wide` a corner and the size."""
    return image_rows(rows, uri=uri, category=category, box=(extent if wide else corners)(cells, at), split=F.lit(split))


def center_boxes(rows: DataFrame, uri: Column, cells: Column, at: int, category: Column) -> DataFrame:
    """One box a row from cells of text x, y (of the middle), width, height; half sizes are cut to whole pixels."""
    v = [F.get(cells, F.lit(at + i)).try_cast("double") for i in range(4)]
    x, y = v[0] - F.floor(v[2] / 2), v[1] - F.floor(v[3] / 2)
    return image_rows(rows, uri=uri, category=category, box=B.box(x, y, x + v[2], y + v[3]))


def blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """name, line: of texts in which the name of a file, a count, and as many lines follow one another."""
    block = F.explode(F.split(text, r"(?m)(?=^\S*/\S+$)")).alias("b")
    lines = F.filter(F.split("b", r"\r?\n"), lambda x: F.trim(x) != "")
    b = texts.select(block).select(lines.alias("l")).where(F.size("l") >= 2)
    body = F.slice("l", F.lit(3), F.get("l", F.lit(1)).try_cast("int"))
    return b.select(F.trim(F.get("l", F.lit(0))).alias("name"), F.explode(body).alias("line"))


def ellipse_boxes(texts: DataFrame, text: str = "value") -> DataFrame:
    """Faces of blocks of ellipses: half axes, angle, middle; the box takes the axes without the angle."""
    e = blocks(texts, text).select("name", F.split(F.trim("line"), " +").alias("c"))
    v = [F.get("c", F.lit(i)).try_cast("double") for i in range(5)]
    return image_rows(e, uri=F.concat("name", F.lit(".jpg")), category=F.lit("face"), box=B.from_centroid(v[3], v[4], 2 * v[1], 2 * v[0]))


def block_boxes(texts: DataFrame, text: str = "value") -> DataFrame:
    """Faces of blocks of boxes: corner and size."""
    e = blocks(texts, text).select("name", F.split(F.trim("line"), " +").alias("c"))
    return cell_boxes(e, F.col("name"), F.col("c"), 0, F.lit("face"), wide=True)


def same_or_not(lines: DataFrame, folder: str) -> DataFrame:
    """Pairs of face files of lines 'name n m' (same) and 'name n name m' (not): uri_a, uri_b, same."""
    c = F.split("value", "\t")
    p = lines.select(c.alias("c")).where(F.size("c").isin(3, 4))
    file = lambda name, n: F.concat(F.lit(f"{folder}/"), name, F.lit("/"), name, F.lit("_"), F.lpad(F.trim(n), F.greatest(F.length(F.trim(n)), F.lit(4)), F.lit("0")), F.lit(".jpg"))
    g = lambda i: F.get("c", F.lit(i))
    same = F.size("c") == 3
    return p.select(file(g(0), g(1)).alias("uri_a"), file(F.when(same, g(0)).otherwise(g(2)), F.when(same, g(2)).otherwise(g(3))).alias("uri_b"), same.alias("same"))


# --- registry -----------------------------------------------------------------------------------


class Registry:
    """Data sets by name; 'name:split' asks for one split, a tuple for the interleaved union.

    A maker takes (spark, folder) and gives one frame, or a frame by split (as functions without arguments)."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable] = {}
        self._alias: dict[str, str] = {}

    def add(self, name: str, maker: Callable, *aliases: str) -> None:
        self._makers[name] = maker
        self._alias |= {a: name for a in aliases}

    def names(self) -> list[str]:
        return sorted(self._makers)

    def get(self, name: str | tuple[str, ...], spark: SparkSession | None = None, folder: str | None = None):
        """The set's frame; without a split 'train' where the set has splits."""
        from framelake.operators.collection import Collection

        if isinstance(name, tuple):
            first, *rest = [Collection.cast(None, self.get(n, spark, folder)) for n in name]
            return first.union(*rest).df
        base, _, split = name.partition(":")
        base = self._alias.get(base, base)
        if base not in self._makers:
            raise KeyError(f"{name}: not one of {', '.join(self.names())}")
        made = self._makers[base](spark, folder)
        if isinstance(made, dict):
            split = split or next(iter(made))
            if split not in made:
                raise KeyError(f"{base} has the splits {', '.join(made)}")
            return made[split]()
        return made.where(F.col("split") == split) if split else made
