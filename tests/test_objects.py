from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as E
from framelake.plans.views import objects

T = datetime(2024, 1, 1)
DET = "detection_id long, image_id long, category string, conf double, xmin double, ymin double, xmax double, ymax double, normalized_coordinates boolean, ingested_at timestamp"
IMG = "image_id long, filename string, instanceid string, category string, tags array<string>, confidences map<string,double>, width int, height int, source_name string, release_no int, ingested_at timestamp"


def tables(spark, folder):
    det = [
        (1, 1, "car", 0.9, 10.0, 10.0, 50.0, 50.0, False, T),
        (2, 1, "car", 0.8, 0.5, 0.5, 0.1, 0.1, True, T),  # the same box, normalized, corners swapped
        (3, 2, None, 0.7, 1.0, 1.0, 5.0, 5.0, None, T),
        (4, 3, "bus", None, 1.0, 1.0, 5.0, 5.0, False, T),
        (5, 4, "bus", 0.5, 0.1, 0.1, 0.5, 0.5, True, T),  # size of the image unknown
    ]
    img = [(i, "f", None, "car", None, None, None if i == 4 else 100, 100, "s", 1, T) for i in range(1, 6)]
    spark.createDataFrame(det, DET).write.parquet(f"{folder}/detection.parquet")
    spark.createDataFrame(img, IMG).write.parquet(f"{folder}/image.parquet")
    return str(folder)


def test_every_live_detection_counts(spark, tmp_path):
    d, run = tables(spark, tmp_path), E.queries()
    box = {r["detection_id"]: r["box"] for r in objects(spark, d).collect()}
    assert sorted(box) == [1, 2, 3, 4, 5] and tuple(box[2]) == (10, 10, 50, 50)
    assert box[5] is None
    assert [r["image_id"] for r in run["images_without_objects"](spark, d).collect()] == [5]
    assert [(r["a_id"], r["b_id"], r["iou"]) for r in run["pair_iou_join"](spark, d).collect()] == [(1, 2, 1.0)]
    assert sorted(r["detection_id"] for r in run["nms"](spark, d).collect()) == [1, 3]
    assert {r["key"]: r["n"] for r in run["category_frequency"](spark, d).collect()} == {"car": 2, "bus": 2}
    assert sorted(r["detection_id"] for r in run["ascii_bars"](spark, d).collect()) == [1, 2, 3, 5]
    assert run["scene_union"](spark, d).agg(F.sum("n")).first()[0] == 5
    assert {r["id"]: (r["category"], r["conf"]) for r in run["archive_round_trip"](spark, d).collect()} == {"1": ("car", 0.9), "2": ("car", 0.8), "3": (None, 0.7), "4": ("bus", None), "5": ("bus", 0.5)}
