"""Readers of row files and object archives, and their writers."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import box as B
from framelake.functions.strings import IMAGE, VIDEO, file_tail, is_image_url, parent


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True, recursive: bool = True) -> DataFrame:
    r = spark.read.option("multiLine", not lines).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json*")
    return (r.schema(schema) if schema else r).json(path)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = False, comment: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of a separated file; quoted cells are read as the writer wrote them; blanks around cells go."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
    r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if comment:
        r = r.option("comment", comment)
    return (r.schema(schema) if schema else r).csv(path)


def read_text(spark: SparkSession, path: str, whole: bool = False, pattern: str | None = None, recursive: bool | None = None) -> DataFrame:
    """Lines, or whole files, as column value."""
    return spark.read.text(path, wholetext=whole, pathGlobFilter=pattern, recursiveFileLookup=recursive)


def read_matrix(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Rows of numbers as array<double>."""
    cells = F.filter(F.split(F.trim("value"), f"[{sep}]+"), lambda x: x != "")
    return spark.read.text(path).select(F.transform(cells, lambda x: x.cast("double")).alias("row"))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the top-level scalars of YAML files."""
    line = F.explode(F.split("value", "\n")).alias("line")
    t = read_text(spark, path, whole=True).select(F.input_file_name().alias("path"), line)
    k, v = F.regexp_extract("line", r"^([A-Za-z_][\w-]*):\s*(.*)$", 1), F.regexp_extract("line", r"^([A-Za-z_][\w-]*):\s*(.*?)\s*(?:#.*)?$", 2)
    return t.select("path", k.alias("key"), F.regexp_replace(v, r"""^["'](.*)["']$""", "$1").alias("value")).where("key <> ''")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of files; their contents are not read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def _ending_in(endings: list[str]) -> str:
    """Pattern of file names with one of the endings, in small letters or capitals."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


def list_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, path, _ending_in(IMAGE), recursive)


def list_videos(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, path, _ending_in(VIDEO), recursive)


def count_by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(parent("path").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, category): the name of an image's folder is its category."""
    return list_images(spark, path).select("path", parent("path").alias("category"), file_tail("path").alias("filename"))


def image_urls(df: DataFrame, url: str) -> DataFrame:
    return df.where(is_image_url(url))


def frames_of(files: DataFrame, video: Column, sortkey: Column) -> DataFrame:
    """(video, frame, path): ordered files of a video as frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("video").orderBy("k", "path")
    return files.select(video.alias("video"), "path", sortkey.alias("k")).withColumn("frame", F.row_number().over(w) - 1).drop("k")


# --- object archives ----------------------------------------------------------------------------

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
_BOXJ = "struct<xmin:double,ymin:double,xmax:double,ymax:double,_xmin:double,_ymin:double,_xmax:double,_ymax:double,id:string,_id:string,label:string,confidence:double,attributes:struct<tags:array<string>,confidences:map<string,double>,normalized_coordinates:boolean>>"
_TRACKJ = f"struct<id:string,_id:string,label:string,_label:string,framerate:double,_framerate:double,interpolation:string,boundary:string,_boundary:string,keyframes:array<int>,_keyframes:array<int>,keyboxes:array<{_BOXJ}>,_keyboxes:array<{_BOXJ}>>"
_ACTJ = "struct<id:string,_id:string,label:string,_label:string,startframe:int,_startframe:int,endframe:int,_endframe:int,framerate:double,_framerate:double,trackid:array<string>,_trackid:array<string>,actorid:string,_actorid:string>"
SCENE = f"struct<filename:string,url:string,framerate:double,startframe:int,endframe:int,tracks:map<string,{_TRACKJ}>,activities:map<string,{_ACTJ}>>"
IMAGE_SCENE = f"struct<filename:string,url:string,attributes:map<string,string>,tags:array<string>,objectlist:struct<Detection:array<{_BOXJ}>>>"
#: Schema by class of an archive's envelope {"<class ...>": payload}.
CLASSES = {"Scene": SCENE, "Image": IMAGE_SCENE, "Detection": _BOXJ, "Track": _TRACKJ, "Activity": _ACTJ}


def either(s: Column, name: str) -> Column:
    """A field or its older form with an underscore before it."""
    return F.coalesce(s[name], s["_" + name])


def parse_detection(s: Column) -> Column:
    """id, category, conf and box of a serialized detection, older layouts included."""
    tags, confs = s["attributes"]["tags"], s["attributes"]["confidences"]
    cat = F.coalesce(F.get(tags, F.lit(0)), s["label"])
    conf = F.coalesce(F.try_element_at(confs, cat), s["confidence"])
    b = B.box(*[either(s, c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return F.struct(either(s, "id").alias("id"), cat.alias("category"), conf.alias("conf"), b.alias("box"), F.coalesce(s["attributes"]["normalized_coordinates"], F.lit(False)).alias("normalized"))


def unwrap(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Payload of the envelope as a struct of its class (column `payload`), whatever the class text."""
    m = F.from_json(F.col(col), f"map<string,string>")
    return df.withColumn("payload", F.from_json(F.get(F.map_values(m), F.lit(0)), CLASSES[kind]))


def scene_keyboxes(scenes: DataFrame, video: str) -> DataFrame:
    """(video_id, track_id, category, framerate, frame, box, conf) of the tracks of scene payloads."""
    t = scenes.select(F.col(video).alias("video_id"), F.explode(F.map_values("payload.tracks")).alias("t"))
    pairs = F.arrays_zip(either(F.col("t"), "keyframes").alias("f"), either(F.col("t"), "keyboxes").alias("b"))
    e = t.select("video_id", "t", F.explode(pairs).alias("p")).withColumn("d", parse_detection(F.col("p.b")))
    return e.select("video_id", either(F.col("t"), "id").alias("track_id"), either(F.col("t"), "label").alias("category"), either(F.col("t"), "framerate").alias("framerate"), F.col("p.f").alias("frame"), "d.box", "d.conf")


def scene_activities(scenes: DataFrame, video: str) -> DataFrame:
    a = scenes.select(F.col(video).alias("video_id"), F.explode(F.map_values("payload.activities")).alias("a"))
    names = {"id": "activity_id", "label": "category", "startframe": "startframe", "endframe": "endframe", "framerate": "framerate", "trackid": "track_ids", "actorid": "actor_id"}
    return a.select("video_id", *[either(F.col("a"), k).alias(v) for k, v in names.items()])


# --- sinks --------------------------------------------------------------------------------------


def to_envelope(row: Column, kind: str) -> Column:
    """JSON text {"<class kind>": {...}} of a struct; null fields are left out."""
    return F.concat(F.lit('{"<class \'' + kind + '\'>": '), F.to_json(row), F.lit("}"))


def detection_json(ident: Column, category: Column, conf: Column, box: Column) -> Column:
    attrs = F.struct(F.array(category).alias("tags"), F.when(conf.isNotNull() & category.isNotNull(), F.create_map(category, conf)).alias("confidences"))
    alone = F.when(category.isNull(), conf).alias("confidence")  # no category to file it under
    return F.struct(*[box[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], ident.cast("string").alias("id"), alone, attrs.alias("attributes"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_text(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def write_paged(df: DataFrame, path: str, page: Column, mode: str = "errorifexists") -> None:
    """Parquet partitioned by a page number, so that a page is read alone."""
    df.withColumn("page", page).repartition("page").write.mode(mode).partitionBy("page").parquet(path)


def read_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("page") == page)


def data_uri(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def remote(path: Column, host: str) -> Column:
    return F.concat(F.lit(f"scp://{host}:"), path)


# --- contents of files --------------------------------------------------------------------------


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return r.load(path).select("path", "content")


def with_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha1, md5 and sha256 of the contents."""
    c = F.col(content)
    return files.withColumns({"sha1": F.sha1(c), "md5": F.md5(c), "sha256": F.sha2(c, 256)})


def verified(files: DataFrame, digests: DataFrame, digest: str = "sha1") -> DataFrame:
    """Files whose digest is the stated one (path, <digest>); others, changed or unknown, are left out."""
    return with_digests(files).join(digests.select("path", F.lower(digest).alias(digest)), ["path", digest], "left_semi")


def unpacked(files: DataFrame) -> DataFrame:
    """(path, name, content) of the members of zip, tar, tar.gz and tar.bz2 files, and of single gz and
    bz2 files; others, or broken ones, give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                for name, part in members(path, data.as_py() or b""):
                    yield pa.RecordBatch.from_pydict({"path": [path], "name": [name], "content": pa.array([part], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    lower, base = path.lower(), path.rsplit("/", 1)[-1]
    try:
        if lower.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        elif lower.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
        elif lower.endswith(".gz"):
            yield base[:-3], gzip.decompress(data)
        elif lower.endswith(".bz2"):
            yield base[:-4], bz2.decompress(data)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
        return
