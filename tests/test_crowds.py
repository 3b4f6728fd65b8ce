import numpy as np
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators import scene as C
from framelake.streaming import tracker


def test_best_first_equals_one_after_the_other():
    draw = np.random.default_rng(3)
    for _ in range(50):
        full = np.round(draw.random((12, 9)), 1)  # many ties
        i, j = np.nonzero(full > 0.3)
        score, want = np.where(full > 0.3, full, -np.inf), set()
        while np.isfinite(score.max()):
            x, y = np.unravel_index(score.argmax(), score.shape)
            want.add((int(x), int(y)))
            score[x, :] = score[:, y] = -np.inf
        assert set(tracker.best_first(i, j, full[i, j])) == want
    assert tracker.best_first(np.zeros(0, int), np.zeros(0, int), np.zeros(0)) == []


def test_merge_candidates_of_crowded_frames(spark):
    draw = np.random.default_rng(5)
    box = lambda: (float(draw.exponential(60)), float(draw.uniform(0, 90)), float(draw.uniform(4, 12)), 10.0)
    rows = [(t % 2, t, int(f), *box()) for t in range(900) for f in {*draw.integers(0, 40, 2)}]
    k = spark.createDataFrame(rows, "video_id long, track_id long, frame int, x double, y double, w double, h double")
    k = k.select("video_id", "track_id", "frame", B.from_xywh("x", "y", "w", "h").alias("box")).cache()
    g = k.groupBy("video_id", "track_id").agg(F.min("frame").alias("s"), F.max("frame").alias("e"), F.min_by("box", "frame").alias("first"), B.dilate(F.max_by("box", "frame"), 2.0).alias("last")).collect()
    meets = lambda a, b: min(a["xmax"], b["xmax"]) > max(a["xmin"], b["xmin"]) and min(a["ymax"], b["ymax"]) > max(a["ymin"], b["ymin"])
    want = set()
    for a in g:
        near = [b["track_id"] for b in g if b["video_id"] == a["video_id"] and b["track_id"] != a["track_id"] and a["e"] < b["s"] <= a["e"] + 5 and meets(a["last"], b["first"])]
        if len(near) == 1:
            want.add((a["video_id"], a["track_id"], near[0]))
    found = C.merge_candidates(k)
    assert len(want) > 20 and {tuple(r) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair of tracks is a row


def test_sketches_stand_beside_no_distinct_count(spark):
    import __spark_entry__ as E

    plan = E.queries()["sketches_are_close"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Aggregate" in line and "approx_count_distinct" in line and "image_id" in line.partition("keys=[")[2].partition("]")[0])
