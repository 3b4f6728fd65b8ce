"""Published data sets by name: which files of a folder they keep and which recipe reads them.

A maker takes (spark, folder) and gives the frame of a set without splits, or its splits as functions.
Folders hold the unpacked files as they are published; columns are those of `importers`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.functions.strings import parent
from framelake.sources import importers as I
from framelake.sources import readers as R

REGISTRY = I.Registry()


def _set(name: str, *aliases: str):
    def add(maker: Callable) -> Callable:
        REGISTRY.add(name, maker, *aliases)
        return maker

    return add


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return R.read_json(spark, path, schema, lines=False)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _cells(spark: SparkSession, path: str, sep: str = " ", skip: str | None = None) -> DataFrame:
    """Lines as lists of cells (column c); lines that match `skip` are left out."""
    t = spark.read.text(path)
    t = t.where(~F.col("value").rlike(skip)) if skip else t
    return t.where(F.trim("value") != "").select(F.input_file_name().alias("file"), F.split(F.trim("value"), sep).alias("c"))


def _c(i: int) -> Column:
    return F.trim(F.get("c", F.lit(i)))


def _at(root: str, sub: str = "") -> str:
    return f"{root.rstrip('/')}/{sub}" if sub else root


# --- images by folder or file name --------------------------------------------------------------

#: Sets of images whose folder is their category: subfolder by name (fixed values).
FOLDERS = {
    "caltech101": "caltech-101/101_ObjectCategories", "d2d": "", "eurosat": "", "food101": "food-101", "lfw": "lfw", "mit67": "Images", "objectnet": "objectnet-1.0", "mf2": "Megaface_Challenge_1M_disjoint_LOOSE",
    "vggface": "images", "stanford_cars_test": "cars_test", "imagenet2014_det_test": "ILSVRC2013_DET_test",
}


def _folder_maker(sub: str) -> Callable:
    return lambda spark, root: I.by_folder(R.list_images(spark, _at(root, sub)))


for _name, _sub in FOLDERS.items():
    REGISTRY.add(_name, _folder_maker(_sub))


@_set("caltech256")
def caltech256(spark, root):
    """Folders are '001.ak47'."""
    return I.by_folder(R.list_images(spark, _at(root, "256_ObjectCategories")), category=F.get(F.split(parent("path"), r"\."), F.lit(1)))


@_set("coil100")
def coil100(spark, root):
    """Files are 'obj1__45.png': object and turn."""
    f = R.list_images(spark, _at(root, "coil-100")).where(F.contains("path", F.lit("__")))
    turn = F.regexp_extract(I.file_tail("path"), r"__(.*)\.[^.]*$", 1)
    return I.image_rows(f, uri=F.col("path"), category=I.name_part("path", 0, "__"), attributes=F.create_map(F.lit("orientation"), turn))


@_set("places365")
def places365(spark, root):
    of = lambda sub, split: lambda: I.by_folder(R.list_images(spark, _at(root, sub)), split=split)
    return {"train": of("data_256", "train"), "val": of("val_256", "val")}


@_set("vggface2")
def vggface2(spark, root):
    """All images by subject, or those of the published lists."""

    def listed(name: str, split: str) -> DataFrame:
        f = _lines(spark, _at(root, name)).select(F.concat(F.lit(_at(root) + "/"), F.trim("value")).alias("path"))
        return I.by_folder(f, split=split)

    return {"all": lambda: I.by_folder(R.list_images(spark, root)), "train": lambda: listed("train_list.txt", "train"), "test": lambda: listed("test_list.txt", "test")}


@_set("casia", "webface")
def casia(spark, root):
    names = _cells(spark, _at(root, "names.txt")).select(_c(0).alias("subject"), _c(1).alias("name"))
    return I.central_box(R.list_images(spark, root), names, 13.0, 237.0)


@_set("megaface")
def megaface(spark, root):
    """Each image has a JSON file of its own beside it."""
    j = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).schema("bounding_box struct<x:double,y:double,width:double,height:double>").json(_at(root, "FlickrFinal2"))
    j = j.select(F.regexp_replace(F.input_file_name(), r"\.json$", "").alias("path"), "bounding_box")
    b = F.col("bounding_box")
    return I.image_rows(j, uri=F.col("path"), category=F.regexp_replace(I.file_tail("path"), r"\.[^.]*$", ""), box=B.from_xywh(b["x"], b["y"], b["width"], b["height"]))


def _imagenet_names(spark: SparkSession, root: str) -> DataFrame:
    """synset, tags: of one file of lines 'synset names', or of two files of equal length."""
    return I.synset_words(_lines(spark, _at(root, "synset_words.txt")))


def _paired_names(spark: SparkSession, root: str) -> DataFrame:
    from framelake.operators.collection import POS, Collection

    col = lambda n: Collection.of(spark.read.text(_at(root, n)).withColumn("_line", F.monotonically_increasing_id()), ["_line"], n).df
    a, b = col("imagenet21k_wordnet_ids.txt"), col("imagenet21k_wordnet_lemmas.txt")
    j = a.select(POS, F.trim("value").alias("synset")).join(b.select(POS, F.col("value").alias("lemmas")), POS)
    return j.select("synset", I.trimmed_list(F.col("lemmas")).alias("tags"))


@_set("imagenet", "imagenet2012")
def imagenet2012(spark, root):
    def val() -> DataFrame:
        labels = _lines(spark, _at(root, "val_labels.txt")).withColumn("_l", F.monotonically_increasing_id())
        from framelake.operators.collection import POS, Collection

        names = _imagenet_names(spark, root).select(F.col("synset"), F.get("tags", F.lit(0)).alias("category"))
        n = Collection.of(labels, ["_l"], "labels").df.select(F.col(POS).alias("n"), F.trim("value").alias("synset")).join(names, "synset").select("n", "category")
        return I.by_position(R.list_images(spark, _at(root, "ILSVRC2012_img_val")), n)

    return {"train": lambda: I.by_synset(R.list_images(spark, _at(root, "ILSVRC2012_img_train")), _imagenet_names(spark, root), split="train"), "val": val}


@_set("imagenet_localization")
def imagenet_localization(spark, root):
    docs = R.read_text(spark, _at(root, "ILSVRC2012_bbox_train_v2"), True, "*.xml", True)
    return _named_synsets(I.xml_boxes(docs), _imagenet_names(spark, root))


@_set("imagenet2014_det")
def imagenet_detection(spark, root):
    def part(sub: str) -> DataFrame:
        docs = R.read_text(spark, _at(root, sub), True, "*.xml", True)
        return _named_synsets(I.xml_boxes(docs), _paired_names(spark, root))

    return {"train": lambda: part("ILSVRC2014_DET_bbox_train"), "val": lambda: part("ILSVRC2013_DET_bbox_val"), "test": lambda: I.by_folder(R.list_images(spark, _at(root, "ILSVRC2013_DET_test")), category=F.lit(None))}


def _named_synsets(objects: DataFrame, names: DataFrame) -> DataFrame:
    n = names.select(F.col("synset").alias("_s"), F.col("tags").alias("_t"))
    j = I.with_dimension(objects.withColumn("_s", F.col("category")), n, ["_s"], "left")
    return I.image_rows(j, uri=F.col("uri"), category=F.coalesce(F.get("_t", F.lit(0)), F.col("category")), tags=F.coalesce("_t", F.array("category")), box=F.col("box"), attributes=F.create_map(F.lit("wordnet_id"), F.col("_s")))


@_set("imagenet_faces")
def imagenet_faces(spark, root):
    docs = _json(spark, _at(root, "face_annotations_ILSVRC.json"), "url string, bboxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return I.boxes_by_file(docs, "url", "bboxes", lambda o: B.box(o["x0"], o["y0"], o["x1"], o["y1"]))


def _synset_folders(sub: str) -> Callable:
    return lambda spark, root: I.by_synset(R.list_images(spark, _at(root, sub)), _paired_names(spark, root))


REGISTRY.add("imagenet21k", _synset_folders("winter21_whole"))
REGISTRY.add("imagenet21k_resized", _synset_folders("imagenet21k_resized"))


@_set("stanford_dogs")
def stanford_dogs(spark, root):
    """Folders are 'n02085620-Chihuahua'; annotations are XML files without ending."""
    docs = R.read_text(spark, _at(root, "Annotation"), True, recursive=True)
    x = I.xml_boxes(docs.select("value", F.input_file_name().alias("path")), uri=F.regexp_replace("path", r"^.*[/\\]", ""))
    f = R.list_images(spark, _at(root, "Images")).withColumn("uri", F.regexp_replace(I.file_tail("path"), r"\.[^.]*$", ""))
    first = x.groupBy("uri").agg(F.min("box").alias("box"))
    return I.image_rows(f.join(first, "uri", "left"), uri=F.col("path"), category=F.regexp_extract(parent("path"), r"-(.*)$", 1), box=F.col("box"))


@_set("ethzshapes")
def ethzshapes(spark, root):
    """A file of corners beside each image, named by image and class."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.groundtruth").text(root)
    t = t.where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("c"))
    image = F.regexp_replace("path", r"_[A-Za-z]+\.groundtruth$", ".jpg")
    return I.cell_boxes(t, image, F.col("c"), 0, parent("path"))


@_set("food2k")
def food2k(spark, root):
    names = _lines(spark, _at(root, "food2k_names.txt")).select(F.regexp_extract("value", r"^(\d+)\s+(.*)$", 1).alias("k"), F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2).alias("category"))
    labels = _cells(spark, _at(root, "Food2k_label/train_finetune.txt")).select(I.file_tail("file").alias("_"), F.regexp_replace(_c(0), r"^.*[/\\]", "").alias("name"), _c(1).alias("k"))
    return I.by_listed_name(R.list_images(spark, root), labels.join(names, "k").select("name", "category"))


@_set("oxford_flowers_102", "flowers102")
def flowers(spark, root):
    """labels.csv: place in the order of the files, category."""
    labels = R.read_csv(spark, _at(root, "labels.csv"), schema="n bigint, category string")
    return I.by_position(R.list_images(spark, root), labels)


@_set("stanford_cars")
def stanford_cars(spark, root):
    """annotations.csv: file, corners, number of the class; classes.txt: number and name."""
    a = R.read_csv(spark, _at(root, "annotations.csv"), schema="name string, xmin double, ymin double, xmax double, ymax double, k int")
    n = _lines(spark, _at(root, "classes.txt")).select(F.regexp_extract("value", r"^(\d+)\s+(.*)$", 1).cast("int").alias("k"), F.regexp_extract("value", r"^(\d+)\s+(.*)$", 2).alias("category"))
    return I.image_rows(a.join(n, "k"), uri=F.concat(F.lit(_at(root, "cars_train/")), "name"), category=F.col("category"), box=B.box("xmin", "ymin", "xmax", "ymax"))


@_set("celeba")
def celeba(spark, root):
    """Lines 'file identity'; splits by the lines 'file 0|1|2'."""
    ident = _cells(spark, _at(root, "celeba/identity_CelebA.txt")).select(_c(0).alias("name"), _c(1).alias("category"))
    part = _cells(spark, _at(root, "celeba/list_eval_partition.txt")).select(_c(0).alias("name"), _c(1).alias("part"))
    j = ident.join(part, "name")
    of = lambda k, split: lambda: I.image_rows(j.where(F.col("part") == k), uri=F.concat(F.lit(_at(root, "celeba/img_align_celeba/")), "name"), category=F.col("category"), split=F.lit(split))
    return {"train": of("0", "train"), "val": of("1", "val"), "test": of("2", "test")}


@_set("lfw_pairs")
def lfw_pairs(spark, root):
    return I.same_or_not(_lines(spark, _at(root, "lfw/pairs.txt")), _at(root, "lfw"))


# --- images by lists of boxes or addresses ------------------------------------------------------


@_set("cc12m")
def cc12m(spark, root):
    c = _cells(spark, _at(root, "cc12m.tsv"), "\t")
    return I.image_rows(c, uri=_c(0), category=_c(1), captions=F.array(_c(1)))


@_set("facescrub")
def facescrub(spark, root):
    rows = _cells(spark, _at(root, "facescrub_act*.txt"), "\t", skip=r"^name\t")
    category = F.translate(_c(0), " ", "_")
    e = rows.withColumn("b", F.split(_c(4), ","))
    return I.cell_boxes(e, _c(3), F.col("b"), 0, category)


@_set("fddb")
def fddb(spark, root):
    return I.ellipse_boxes(R.read_text(spark, _at(root, "FDDB-folds"), True, "*ellipseList.txt"))


@_set("widerface")
def widerface(spark, root):
    of = lambda s: lambda: I.block_boxes(R.read_text(spark, _at(root, f"widerface/wider_face_split/wider_face_{s}_bbx_gt.txt"), True))
    return {"train": of("train"), "val": of("val"), "test": lambda: I.by_folder(R.list_images(spark, _at(root, "widerface/WIDER_test")))}


@_set("kitti")
def kitti(spark, root):
    c = _cells(spark, _at(root, "Kitti/raw/training/label_2/*.txt"))
    image = F.regexp_replace(F.regexp_replace("file", "/label_2/", "/image_2/"), r"\.txt$", ".png")
    return {"train": lambda: I.cell_boxes(c, image, F.col("c"), 4, _c(0)), "test": lambda: I.by_folder(R.list_images(spark, _at(root, "Kitti/raw/testing/image_2")), category=F.lit(None))}


@_set("vggface_urls")
def vggface_urls(spark, root):
    """A file of lines 'id url left top right bottom pose score curation' a subject."""
    c = _cells(spark, _at(root, "files/*.txt"))
    return I.cell_boxes(c, _c(1), F.col("c"), 2, F.regexp_extract("file", r"([^/\\]+)\.txt$", 1))


@_set("youtubefaces")
def youtubefaces(spark, root):
    """Lines 'subject\\video\\file,ignored,x,y,width,height,...' about the middle of the face."""
    c = _cells(spark, _at(root, "frame_images_DB/*labeled_faces.txt"), ",")
    name = F.translate(_c(0), "\\", "/")
    return I.center_boxes(c, F.concat(F.lit(_at(root, "frame_images_DB/")), name), F.col("c"), 2, F.get(F.split(name, "/"), F.lit(0)))


@_set("msceleb")
def msceleb(spark, root):
    rows = _cells(spark, _at(root, "faces.tsv"), "\t").select(_c(0).alias("mid"), _c(1).alias("rank"), _c(4).alias("face"), F.element_at("c", -1).alias("data"))
    return I.encoded_faces(rows, _cells(spark, _at(root, "names.tsv"), "\t").select(_c(0).alias("mid"), _c(1).alias("name")))


@_set("aflw")
def aflw(spark, root):
    """Five tables of a database, by a JDBC address in root or as parquet folders of their names."""
    names = ["Faces", "FaceImages", "FaceRect", "FeatureCoords", "FeatureCoordTypes"]
    if root.startswith("jdbc:"):
        t = [spark.read.format("jdbc").options(url=root, dbtable=n).load() for n in names]
    else:
        t = [spark.read.parquet(_at(root, n)) for n in names]
    return I.landmark_faces(*t)


# --- documents ----------------------------------------------------------------------------------


@_set("coco_2014", "coco")
def coco_2014(spark, root):
    return I.coco(_json(spark, _at(root, "annotations/instances_train2014.json"), I.COCO))


@_set("coco_classification")
def coco_classification(spark, root):
    return I.as_classification(coco_2014(spark, root))


@_set("lvis")
def lvis(spark, root):
    of = lambda s: lambda: I.coco(_json(spark, _at(root, f"lvis_v1_{s}.json"), I.COCO))
    return {"train": of("train"), "val": of("val")}


@_set("inaturalist_2021")
def inaturalist(spark, root):
    of = lambda s: lambda: I.one_label(I.coco(_json(spark, _at(root, f"2021/{s}.json"), I.COCO)))
    return {"train": of("train"), "val": of("val")}


@_set("visualgenome")
def visualgenome(spark, root):
    return I.visual_genome(_json(spark, _at(root, "image_data.json"), I.GENOME_IMAGES), _json(spark, _at(root, "objects.json"), I.GENOME_OBJECTS))


@_set("open_images_v7", "open_images")
def open_images(spark, root):
    boxes = R.read_csv(spark, _at(root, "boxes.csv"), header=True, schema="image_id string, source string, label string, confidence double, xmin double, xmax double, ymin double, ymax double")
    labels = R.read_csv(spark, _at(root, "labels.csv"), header=True, schema="image_id string, source string, label string, conf double")
    classes = R.read_csv(spark, _at(root, "classes.csv"), schema="id string, name string")
    b, t = I.open_images(boxes, labels, classes)
    return {"boxes": lambda: b, "labels": lambda: t}


@_set("activitynet")
def activitynet(spark, root):
    docs = lambda: _json(spark, _at(root, "activity_net.v1-3.min.json"), f"database {I.ACTIVITYNET}")
    return {s: (lambda s=s: I.segments(docs(), s)) for s in ("training", "validation", "testing")}


def _kinetics(n: int) -> Callable:
    def maker(spark, root):
        of = lambda s: lambda: I.labelled_clips(R.read_text(spark, _at(root, f"kinetics{n}/{s}.json"), True))
        return {"train": of("train"), "val": of("validate"), "test": of("test")}

    return maker


REGISTRY.add("kinetics700", _kinetics(700), "kinetics")
REGISTRY.add("kinetics600", _kinetics(600))
REGISTRY.add("kinetics400", _kinetics(400))


@_set("tiny_virat")
def tiny_virat(spark, root):
    def part(split: str, file: str) -> DataFrame:
        docs = _json(spark, _at(root, f"TinyVIRAT_V2/{file}"), "path string" + (", label array<string>" if split != "test" else ""))
        return I.tagged_videos(docs, _at(root, "TinyVIRAT_V2/videos"), split)

    return {"train": lambda: part("train", "tiny_train_v2.json"), "val": lambda: part("val", "tiny_val_v2.json"), "test": lambda: part("test", "tiny_test_v2_public.json")}


# --- videos -------------------------------------------------------------------------------------


@_set("charades")
def charades(spark, root):
    def part(name: str) -> DataFrame:
        t = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(_at(root, name))
        classes = _lines(spark, _at(root, "Charades_v1_classes.txt"))
        return I.charades(t.select("id", "scene", "actions"), classes, 30.0)

    return {"train": lambda: part("Charades_v1_train.csv"), "test": lambda: part("Charades_v1_test.csv")}


@_set("multimoments", "momentsintime")
def multimoments(spark, root):
    of = lambda f: lambda: I.moments(_lines(spark, _at(root, f)), _lines(spark, _at(root, "moments_categories.txt")))
    return {"train": of("trainingSet.txt"), "val": of("validationSet.txt")}


@_set("ava")
def ava(spark, root):
    def part(name: str) -> tuple[DataFrame, DataFrame]:
        rows = R.read_csv(spark, _at(root, name), schema="video_id string, middle_sec double, xmin double, ymin double, xmax double, ymax double, action_id bigint, person_id bigint")
        return I.ava(rows, R.read_csv(spark, _at(root, "ava_action_list.csv"), schema="action_id bigint, category string"))

    return {f"{s}_{k}": (lambda s=s, i=i: part(f"ava_{s}_v2.2.csv")[i]) for s in ("train", "val") for i, k in enumerate(("tracks", "activities"))}


@_set("youtubebb", "youtubeBB")
def youtubebb(spark, root):
    return I.youtube_boxes(R.read_csv(spark, _at(root, "yt_bb_detection_train.csv"), schema="youtube_id string, timestamp_ms bigint, class_id int, class_name string, object_id bigint, presence string, xmin double, xmax double, ymin double, ymax double"))


@_set("ucf101")
def ucf101(spark, root):
    return I.by_folder(R.list_videos(spark, root), category=I.name_part("path", 1))


@_set("hmdb")
def hmdb(spark, root):
    return I.by_folder(R.list_videos(spark, root))


#: People of the training part (fixed values).
KTH_TRAIN = ["person02", "person03", "person05", "person06", "person07", "person08", "person09", "person10", "person22"]


@_set("kthactions")
def kthactions(spark, root):
    f = R.list_videos(spark, root)
    own = I.name_part("path", 0).isin(KTH_TRAIN)
    of = lambda cond, split: lambda: I.by_folder(f.where(cond), category=I.name_part("path", 1), split=split)
    return {"train": of(own, "train"), "test": of(~own, "test")}


@_set("meva_kf1")
def meva(spark, root):
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yml").text(root)
    lines = t.select(F.regexp_replace(I.file_tail(F.input_file_name()), r"[-.](activities|geom|types)\.yml$", "").alias("video"), "value")
    boxes, acts = I.meva(lines)
    return {"tracks": lambda: boxes, "activities": lambda: acts}


def _archive(sub: str) -> Callable:
    """Serialized scenes: one object a line, or one array a file."""

    def maker(spark, root):
        text = R.read_text(spark, _at(root, sub), True, "*.json", True)
        many = F.coalesce(F.from_json("value", "array<string>"), F.split("value", r"\n(?=\{)"))
        j = R.unwrap(text.select(F.explode(many).alias("value")), "value", "Scene").withColumn("v", F.coalesce("payload.filename", "payload.url"))
        return {"tracks": lambda: R.scene_keyboxes(j, "v"), "activities": lambda: R.scene_activities(j, "v")}

    return maker


#: Archives of video scenes: subfolder by name (fixed values).
for _name, _sub in {"cap": "cap_classification_clip/annotations", "cap_pad": "cap_classification_pad/annotations", "cap_detection": "cap_detection_handheld_val/annotations", "pip_175k": "pip_175k", "pip_370k": "pip_370k_stabilized"}.items():
    REGISTRY.add(_name, _archive(_sub))


# --- tables -------------------------------------------------------------------------------------

#: Names of the ten classes (fixed values).
CIFAR10 = ["airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck"]
#: Names of the classes of objects in order (fixed values).
VOC = ["aeroplane", "bicycle", "bird", "boat", "bottle", "bus", "car", "cat", "chair", "cow", "diningtable", "dog", "horse", "motorbike", "person", "pottedplant", "sheep", "sofa", "train", "tvmonitor", "background"]


def _splits(spark: SparkSession, root: str, of: Callable[[DataFrame, str], DataFrame], names: dict[str, str]) -> dict:
    """Splits of a set kept as parquet folders; names: folder by split."""
    return {s: (lambda s=s, sub=sub: of(spark.read.parquet(_at(root, sub)), s)) for s, sub in names.items()}


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, [n]) for i, n in enumerate(names)], "label bigint, tags array<string>")


def _names_file(spark: SparkSession, root: str, sep: str = ",") -> DataFrame:
    """label, tags of labels.csv: number, names parted by `sep`."""
    t = _lines(spark, _at(root, "labels.txt"))
    form = r"^(\d+)\s+(.*)$"
    return t.select(F.regexp_extract("value", form, 1).cast("bigint").alias("label"), I.trimmed_list(F.regexp_extract("value", form, 2), sep).alias("tags"))


def _numbered(rows: DataFrame, split: str, name: str, label: str, names: DataFrame) -> DataFrame:
    """Rows named by set, split and a stable hash of the picture where they have no path."""
    image = "image" if "image" in rows.columns else "img"
    uri = F.coalesce(F.col(f"{image}.path"), F.concat(F.lit(f"{name}:{split}:"), F.sha1(F.col(f"{image}.bytes"))))
    return I.numbered_classes(rows.withColumn("uri", uri), label, names, "uri", split)


@_set("mnist")
def mnist(spark, root):
    return _splits(spark, root, lambda r, s: _numbered(r, s, "mnist", "label", _names(spark, [str(i) for i in range(10)])), {"train": "train", "test": "test"})


@_set("cifar10")
def cifar10(spark, root):
    return _splits(spark, root, lambda r, s: _numbered(r, s, "cifar10", "label", _names(spark, CIFAR10)), {"train": "train", "test": "test"})


@_set("cifar100")
def cifar100(spark, root):
    """labels.txt names the fine classes, coarse.txt the coarse ones."""

    def of(r: DataFrame, s: str) -> DataFrame:
        form = r"^(\d+)\s+(.*)$"
        coarse = _lines(spark, _at(root, "coarse.txt")).select(F.regexp_extract("value", form, 1).cast("bigint").alias("label"), F.array(F.regexp_extract("value", form, 2)).alias("tags"))
        r = r.withColumn("uri", F.concat(F.lit(f"cifar100:{s}:"), F.sha1("img.bytes")))
        return I.numbered_classes(r, "fine_label", _names_file(spark, root), "uri", s, "coarse_label", coarse)

    return _splits(spark, root, of, {"train": "train", "test": "test"})


@_set("sun397")
def sun397(spark, root):
    return _splits(spark, root, lambda r, s: _numbered(r, s, "sun397", "label", _names_file(spark, root, "/")), {"train": "train", "test": "test", "other": "other"})


@_set("tiny_imagenet")
def tiny_imagenet(spark, root):
    return _splits(spark, root, lambda r, s: _numbered(r, s, "tiny_imagenet", "label", _names_file(spark, root)), {"train": "train", "val": "valid"})


@_set("wakevision")
def wakevision(spark, root):
    names = lambda: spark.createDataFrame([(0, ["non-person"]), (1, ["person"])], "label bigint, tags array<string>")
    return _splits(spark, root, lambda r, s: _numbered(r, s, "wakevision", "person", names()), {"train": "train_quality", "val": "validation", "test": "test"})


def _captioned(name: str, url: str, *captions: str, **splits: str) -> None:
    def of(r: DataFrame, s: str) -> DataFrame:
        address = F.col(url) if url in r.columns else F.concat(F.lit(f"{name}:{s}:"), F.sha1("image.bytes"))
        return I.captioned(r, address, [F.col(c) for c in captions], s)

    REGISTRY.add(name, lambda spark, root: _splits(spark, root, of, splits))


#: Sets of addresses and captions: column of the address, columns of the captions, splits.
_captioned("flickr30k", "filename", "caption", test="test")
_captioned("yfcc100m", "downloadurl", "title_clean", "description_clean", train="train", val="validation")
_captioned("coyo700m", "url", "text", train="train")
_captioned("laion2b", "url", "caption", train="train")
_captioned("datacomp_1b", "url", "text", train="train")
_captioned("imageinwords", "image/key", "IIW", test="test")
_captioned("docci", "image_file", "description", train="train", test="test")
_captioned("as100m", "url", "caption", train="train")


@_set("coyo300m")
def coyo300m(spark, root):
    """labels.txt: class and its names; labels above a probability of 0.2 count."""
    names = lambda: _names_file(spark, root)

    def of(r: DataFrame, s: str) -> DataFrame:
        kept = I.parallel_labels(r.select("url", "labels", "label_probs"), "labels", "label_probs", 0.2)
        e = kept.select("url", F.posexplode_outer("tags").alias("place", "label")).join(names(), "label", "left")
        g = e.groupBy("url").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "tags")))), lambda x: x["tags"])).alias("tags"))
        return I.image_rows(g, uri=F.col("url"), tags=F.col("tags"), category=F.get("tags", F.lit(0)), split=F.lit(s))

    return _splits(spark, root, of, {"train": "train"})


@_set("pascal_voc_2007", "pascal")
def pascal_voc(spark, root):
    name = F.array(*[F.lit(v) for v in VOC])

    def of(r: DataFrame, s: str) -> DataFrame:
        objects = F.arrays_zip(F.col("objects.classes").alias("k"), F.col("objects.bboxes").alias("b"))
        tags = F.transform("classes", lambda c: F.get(name, c))
        return I.boxed(r, F.col("image.path"), objects, lambda o: F.get(name, o["k"]), lambda o: B.box(*[F.get(o["b"], F.lit(i)) for i in range(4)]), tags, s)

    return _splits(spark, root, of, {"train": "train", "val": "validation", "test": "test"})


@_set("objects365")
def objects365(spark, root):
    of = lambda r, s: I.boxed(r, F.col("image_path"), F.col("anns_info"), lambda o: o["category"], lambda o: B.box(*[F.get(o["bbox"], F.lit(i)) for i in range(4)]), split=s)
    return _splits(spark, root, of, {"train": "train", "val": "validation"})


@_set("oxford_pets")
def oxford_pets(spark, root):
    of = lambda r, s: I.boxed(r, F.col("image_id"), F.col("label_bbox_enriched"), lambda o: o["label"], lambda o: B.from_xywh(*[F.get(o["bbox"], F.lit(i)) for i in range(4)]), F.array("label_breed"), s)
    return _splits(spark, root, of, {"train": "train", "test": "test"})


@_set("oxford_fgvc_aircraft")
def aircraft(spark, root):
    def of(r: DataFrame, s: str) -> DataFrame:
        b = F.col("bbox")
        n = _names_file(spark, root, "\t")
        j = I.with_dimension(r.withColumnRenamed("family", "label"), n, ["label"], "left")
        return I.image_rows(j, uri=F.col("image.path"), category=F.get("tags", F.lit(0)), tags=F.col("tags"), box=B.box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), split=F.lit(s))

    return _splits(spark, root, of, {"train": "train"})


@_set("rasmd")
def rasmd(spark, root):
    """Files .../swir/..._12.png and .../rgb/..._12.png of one scene side by side."""
    number = F.regexp_extract(I.file_tail("path"), r"_(\d+)\.[^.]*$", 1).cast("bigint")
    f = R.list_images(spark, _at(root, "RASMD_DATASET")).select(number.alias("number"), "path").where("number is not null")
    return I.paired_modalities(f.where(F.contains("path", F.lit("rgb/"))), f.where(F.contains("path", F.lit("swir/"))), "number")
