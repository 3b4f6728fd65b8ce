from pyspark.sql import functions as F

import __spark_entry__ as E


def events(spark, folder, rows):
    """Table of events from (event_id, user_id, frame, value): user_id is the track, user_id % 5 the video."""
    e = spark.createDataFrame(rows, "event_id long, user_id long, frame long, value double")
    e = e.select("event_id", "user_id", F.timestamp_seconds((F.col("frame") + 473352) * 3600).alias("ts"), F.lit("click").alias("event_type"), "value")
    e.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_pairs_meet_on_all_common_frames(spark, tmp_path):
    # Common frames 2 .. 6 hold no multiple of 24; the boxes agree at frame 2 and part after.
    d, run = events(spark, tmp_path, [(1, 0, 1, 0.0), (701, 0, 9, 0.0), (1401, 5, 2, 0.0), (2101, 5, 6, 16.0)]), E.queries()
    iou = [(21 - x) / (21 + x) for x in (0, 4, 8, 12, 16)]
    (p,) = run["track_pair_iou"](spark, d).collect()
    assert (p["a_track"], p["b_track"], p["frames"]) == (0, 5, 5)
    for name, want in (("mean_iou", sum(iou) / 5), ("max_iou", 1.0), ("min_iou", iou[-1]), ("top_iou", sum(iou[:2]) / 2)):
        assert abs(p[name] - want) < 1e-5, name
    assert [(r["track_id"], r["into"]) for r in run["scene_dedupe_candidates"](spark, d).collect()] == [(5, 0)]
    assert [(r["src"], r["dst"]) for r in run["greedy_track_assignment"](spark, d).collect()] == [(5, 0)]


def test_frames_without_overlap_count_as_zero(spark, tmp_path):
    # Apart by 0, 25, 50, 75 and 100 at frames 2 .. 6; boxes are 21 wide.
    d = events(spark, tmp_path, [(1, 0, 1, 0.0), (701, 0, 9, 0.0), (1401, 5, 2, 0.0), (2101, 5, 6, 100.0)])
    iou = [max(0, 21 - x) / (42 - max(0, 21 - x)) for x in (0, 25, 50, 75, 100)]
    (p,) = E.queries()["track_pair_iou"](spark, d).collect()
    assert p["frames"] == 5 and p["min_iou"] == 0 and abs(p["mean_iou"] - sum(iou) / 5) < 1e-5 and abs(p["top_iou"] - 0.5) < 1e-5


def test_union_and_mosaic_read_every_video(spark, tmp_path):
    # Videos 0, 1 and 3: tracks 0 and 5, 1 and 6, 3 alone.
    rows = [(1, 0, 1, 0.0), (2, 5, 1, 10.0), (3, 1, 1, 20.0), (4, 6, 1, 40.0), (5, 3, 1, 7.0), (6, 3, 3, 7.0)]
    d, run = events(spark, tmp_path, rows), E.queries()
    union = {(r["video_id"], r["frame"]): r["xmin"] for r in run["track_union_average"](spark, d).collect()}
    assert union == {(0, 1): 5.0, (1, 1): 30.0, (3, 1): 7.0, (3, 3): 7.0}
    got = sorted((r["left_video"], r["right_video"], r["frame"], r["left_boxes"], r["right_boxes"]) for r in run["mosaic_frames"](spark, d).collect())
    assert got == [(0, 1, 1, 2, 2), (1, 3, 1, 2, 1)]
