import json

import pytest
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.sources import importers as I
from framelake.sources import readers as R


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"', 1), ("plain", None, 2)]
    df = spark.createDataFrame(rows, "s string, t string, n int")
    R.write_csv(df, str(tmp_path / "c"))
    got = R.read_csv(spark, str(tmp_path / "c"), header=True, schema="s string, t string, n int")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_scene_archive_with_older_layout(spark, tmp_path):
    box = lambda **x: {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4} | x
    new = {"filename": "v.mp4", "tracks": {"t": {"id": "t", "label": "car", "framerate": 30, "keyframes": [0, 5], "keyboxes": [box(attributes={"tags": ["car"], "confidences": {"car": 0.5}}), box(xmin=9)]}}, "activities": {"a": {"id": "a", "label": "turns", "startframe": 1, "endframe": 4, "trackid": ["t"]}}}
    old = {"filename": "w.mp4", "tracks": {"u": {"_id": "u", "_label": "dog", "_keyframes": [3], "_keyboxes": [{"_xmin": 5, "_ymin": 6, "_xmax": 7, "_ymax": 8, "label": "dog", "confidence": 0.9}]}}}
    p = tmp_path / "s.txt"
    p.write_text("\n".join(json.dumps({"<class 'x.Scene'>": s}) for s in (new, old)))
    s = R.unwrap(spark.read.text(str(p)), "value", "Scene").withColumn("v", F.col("payload.filename"))
    k = {(r["video_id"], r["track_id"], r["category"], r["frame"], r["box"]["xmin"], r["conf"]) for r in R.scene_keyboxes(s, "v").collect()}
    assert k == {("v.mp4", "t", "car", 0, 1.0, 0.5), ("v.mp4", "t", "car", 5, 9.0, None), ("w.mp4", "u", "dog", 3, 5.0, 0.9)}
    assert [(r["category"], r["startframe"], r["track_ids"]) for r in R.scene_activities(s, "v").collect()] == [("turns", 1, ["t"])]


def test_detection_round_trip(spark):
    df = spark.createDataFrame([(1, "car", 0.5), (2, "dog", None)], "id long, c string, conf double")
    j = df.select(R.to_envelope(R.detection_json(F.col("id"), F.col("c"), F.col("conf"), B.box(1, 2, 3, 4)), "Detection").alias("j"))
    back = R.unwrap(j, "j", "Detection").select(R.parse_detection(F.col("payload")).alias("d")).select("d.*").collect()
    assert {(r["id"], r["category"], r["conf"], tuple(r["box"])) for r in back} == {("1", "car", 0.5, (1, 2, 3, 4)), ("2", "dog", None, (1, 2, 3, 4))}


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"image_id": 1, "category_id": 9, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 9, "name": "car"}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    got = {(r["image_id"], r["category"], r["box"] and tuple(r["box"])) for r in I.coco(R.read_json(spark, str(tmp_path / "x.json"), I.COCO, lines=False)).collect()}
    assert got == {(1, "car", (1, 2, 4, 6)), (2, None, None)}


def test_segments_boxes_and_labels(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"database": {"v": {"url": "u", "subset": "training", "annotations": [{"label": "run", "segment": [1.0, 2.5]}]}, "w": {"subset": "testing", "annotations": []}}}))
    assert [(r["video_id"], r["startframe"], r["endframe"]) for r in I.segments(R.read_json(spark, str(tmp_path / "s.json"), f"database {I.ACTIVITYNET}", lines=False), "training").collect()] == [("v", 30, 75)]
    y = spark.createDataFrame([("v", 1099, "dog", 0, "present", 0.1, 0.2, 0.3, 0.4), ("v", 2000, "dog", 0, "absent", -1.0, -1.0, -1.0, -1.0)], "youtube_id string, timestamp_ms int, class_name string, object_id int, presence string, xmin double, xmax double, ymin double, ymax double")
    assert [(r["track_id"], r["frame"]) for r in I.youtube_boxes(y).collect()] == [("dog:0", 32)]
    p = spark.createDataFrame([(["a", "b"], [0.1, 0.9])], "labels array<string>, probs array<double>")
    assert I.parallel_labels(p, "labels", "probs", 0.5).first()["tags"] == ["b"]


def test_registry(spark):
    reg = I.Registry()
    reg.add("toy", lambda *_: spark.createDataFrame([(1, "train"), (2, "val")], "x int, split string"), "t")
    assert reg.get("t:val").collect()[0]["x"] == 2 and reg.names() == ["toy"]
    assert reg.get(("toy:train", "toy:val")).count() == 2
    reg.add("parts", lambda *_: {"train": lambda: spark.range(3), "val": lambda: spark.range(2)})
    assert reg.get("parts").count() == 3 and reg.get("parts:val").count() == 2
    for wrong in ("parts:none", "other"):
        with pytest.raises(KeyError):
            reg.get(wrong)


def test_files_and_yaml(spark, tmp_path):
    for n in ("a/x.jpg", "a/y.PNG", "b/z.png", "b/n.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"1")
    assert {(r["folder"], r["n"]) for r in R.count_by_folder(R.list_images(spark, str(tmp_path))).collect()} == {("a", 2), ("b", 1)}
    (tmp_path / "c.yaml").write_text("name: 'x y'\nsize: 3  # note\n- list\n")
    assert {(r["key"], r["value"]) for r in R.read_yaml(spark, str(tmp_path / "c.yaml")).collect()} == {("name", "x y"), ("size", "3")}
    (tmp_path / "m.txt").write_text("1 2.5\n3 4\n")
    assert sorted(r["row"] for r in R.read_matrix(spark, str(tmp_path / "m.txt")).collect()) == [[1.0, 2.5], [3.0, 4.0]]


def test_archives_are_unpacked(spark, tmp_path):
    import bz2
    import gzip
    import tarfile
    import zipfile

    (tmp_path / "a.txt").write_text("one")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.txt", "two")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.txt", "a.txt")
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"three"))
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(b"four"))
    (tmp_path / "broken.zip").write_bytes(b"no")
    got = {(r["path"].rsplit("/", 1)[1], r["name"], bytes(r["content"])) for r in R.unpacked(R.contents(spark, str(tmp_path))).collect()}
    assert got == {("z.zip", "d/x.txt", b"two"), ("t.tar.gz", "a.txt", b"one"), ("g.csv.gz", "g.csv", b"three"), ("b.csv.bz2", "b.csv", b"four")}


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r["value"] for r in R.read_text(spark, str(tmp_path), whole=True).collect()] == ["one\ntwo\n"] and R.read_text(spark, str(tmp_path)).count() == 2
