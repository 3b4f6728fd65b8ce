from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators import scene as C
from framelake.operators import tracks as K
from framelake.operators.joins import interval_join, nearest
from framelake.streaming import tracker
from framelake.streaming.tracker import Tracker

SCHEMA = "video_id long, track_id long, frame int, box struct<xmin:double,ymin:double,xmax:double,ymax:double>, conf double"


def keys(spark, rows):
    return spark.createDataFrame([(1, t, f, tuple(float(v) for v in b), 0.5) for t, f, b in rows], SCHEMA)


def golden(spark):
    return keys(spark, [(7, 0, (100, 200, 400, 500)), (7, 4, (500, 500, 800, 800)), (7, 8, (900, 900, 999, 999))])


def test_interpolation(spark):
    k = golden(spark)
    f = {r["frame"]: tuple(r["box"]) for r in K.dense(k).collect()}
    assert sorted(f) == list(range(9)) and f[2] == (300, 350, 600, 650) and f[4] == (500, 500, 800, 800)
    want = k.select(*K.T).distinct().select(*K.T, F.explode(F.array(*[F.lit(x) for x in (-2, -1, 2, 8, 9)])).alias("at"))
    strict = {r["at"]: r["box"] and tuple(r["box"]) for r in K.at_frames(k, want).collect()}
    assert strict[-2] is None and strict[9] is None and strict[-1] == f[0] and strict[2] == f[2]
    ext = {r["at"]: tuple(r["box"]) for r in K.at_frames(k, want, "extend").collect()}
    assert ext[9] == f[8] and ext[-2] == f[0]
    assert {r["frame"]: tuple(r["box"]) for r in K.dense(K.dense(k).select(*K.T, "frame", "box", "conf")).collect()} == f


def test_golden_track(spark):
    k = keys(spark, [(1, 1, (0, 0, 10, 11)), (1, 10, (1, 1, 11, 12))])
    s = K.stats(k).first()
    assert tuple(s["unionbox"]) == (0, 0, 11, 12) and s["length"] == 10
    for r in K.dense(k).select(F.round(B.width(F.col("box")), 9).alias("w"), F.round(B.height(F.col("box")), 9).alias("h")).collect():
        assert (r["w"], r["h"]) == (10, 11)
    d = lambda a, b: spark.range(1).select(K.during_interval(F.lit(1), F.lit(10), F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert d(5, 10) and not d(11, 12)


def test_nearest_and_intervals(spark):
    left = spark.createDataFrame([(1, 5, "p"), (1, 11, "q"), (2, 3, "r")], "k int, at int, tag string")
    right = spark.createDataFrame([(1, 3, "a"), (1, 7, "b"), (1, 20, "c")], "k int, f int, v string")
    got = {(r["tag"], r["v"]) for r in nearest(left, right, ["k"], "at", "f", ["v"]).collect()}
    assert got == {("p", "a"), ("q", "b"), ("r", None)}
    a = spark.createDataFrame([(1, i, i + 7) for i in range(0, 60, 5)], "k int, s int, e int")
    b = spark.createDataFrame([(1, i, i + 3) for i in range(0, 60, 9)], "k int, s int, e int")
    for bucket in (2, 10, 1000):
        j = interval_join(a, b, ["k"], ("s", "e"), ("s", "e"), bucket).collect()
        want = {(x, y) for x in range(0, 60, 5) for y in range(0, 60, 9) if x <= y + 3 and y <= x + 7}
        assert len(j) == len(want) and {(r["s"], r["s_2"]) for r in j} == want


def test_merge_candidates_and_gaps(spark):
    k = keys(spark, [(1, 0, (0, 0, 10, 10)), (1, 5, (0, 0, 10, 10)), (2, 8, (5, 5, 15, 15)), (2, 9, (5, 5, 15, 15)), (3, 40, (0, 0, 9, 9))])
    assert [(r["track_id"], r["next_track"]) for r in C.merge_candidates(k).collect()] == [(1, 2)]
    ext = spark.createDataFrame([(1, 0, 100)], "video_id long, startframe int, endframe int")
    acts = spark.createDataFrame([(1, 10, 19), (1, 15, 29), (1, 90, 120)], "video_id long, startframe int, endframe int")
    assert sorted((r["startframe"], r["endframe"]) for r in C.without_activity(ext, acts).collect()) == [(0, 10), (30, 90)]


def test_tracker_keeps_ids():
    t = Tracker()
    ids = []
    for f in range(6):
        got = dict(t.step(f, [(0, "car", 0.9, (f, 0, f + 10, 10)), (1, "car", 0.8, (100 - f, 50, 110 - f, 60))]))
        ids.append((got[0], got[1]))
    assert set(ids) == {(0, 1)}
    assert t.step(20, []) == [] and t.tracks.ids == []


def test_tracker_by_hand():
    t = Tracker(min_conf=0.5, gate=30)
    assert t.step(0, [(1, "car", 0.9, (0, 0, 10, 10)), (2, "car", 0.1, (50, 50, 60, 60)), (3, "dog", 0.9, (0, 0, 10, 10))]) == [(1, 0), (3, 1)]  # 2 is too unsure for a track
    assert t.step(1, [(4, "car", 0.9, (4, 0, 14, 10))]) == [(4, 0)]
    assert t.step(2, [(5, "car", 0.9, (8, 0, 18, 10)), (6, "car", 0.8, (8, 1, 18, 11))]) == [(5, 0)]  # one detection a track; 6 is explained by it
    assert t.step(3, [(7, "dog", 0.6, (35, 0, 45, 10))]) == [(7, 1)]  # meets nothing, but lies within the gate of the free track
    assert t.step(4, [(8, "cat", 0.6, (35, 0, 45, 10))]) == [(8, 2)]
    again = Tracker(t.state(), min_conf=0.5, gate=30)
    assert again.step(5, [(9, "cat", 0.6, (35, 0, 45, 10))]) == [(9, 2)] == t.step(5, [(9, "cat", 0.6, (35, 0, 45, 10))])
    assert t.tracks.confidence(2).tolist() == [0.9, 0.6, 0.6][: len(t.tracks.ids)] or len(t.tracks.ids) == 3


def test_batches_of_any_size_give_the_same_tracks(spark):
    rows = [(v, f, v * 1000 + f * 10 + i, "car", 0.9 - i / 10, 20.0 * i + f, 0.0, 20.0 * i + f + 12, 10.0) for v in range(3) for f in range(30) for i in range(3)] + [(0, 3, 9999, "car", None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id long, frame int, det_id long, category string, conf double, xmin double, ymin double, xmax double, ymax double")
    whole = sorted(map(tuple, tracker.assign_batch(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, tracker.assign_batch(df).collect())) == whole and len(whole) == 270
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for v in range(3):
        t = Tracker()
        for f in range(30):
            for d, k in t.step(f, [(r[2], r[3], r[4], r[5:]) for r in rows if r[0] == v and r[1] == f and r[4] is not None]):
                assert (v, f, d, k) in set(whole)
    assert tracker.assign_batch(df.limit(0)).collect() == []


def test_activities_are_merged_or_suppressed(spark):
    rows = [(1, "run", 5, 0, 10, 0.5), (1, "run", 5, 2, 12, 0.9), (1, "run", 5, 11, 30, 0.2), (1, "run", 6, 0, 10, 0.5), (1, "sit", None, 0, 10, None), (1, "sit", None, 1, 10, 0.3), (2, "run", 5, 9, 9, 0.1), (None, "run", 5, 0, 9, 0.1)]
    df = spark.createDataFrame(rows, "video_id long, category string, actor_id long, startframe int, endframe int, conf double")
    got = lambda **o: sorted((tuple(r) for r in tracker.assign_activities(df, **o).collect()), key=repr)
    assert got() == [(1, "run", 5, 0, 12, 0.9), (1, "run", 5, 11, 30, 0.2), (1, "run", 6, 0, 10, 0.5), (1, "sit", None, 0, 10, 0.3)]
    assert got(merge=False, suppress=True) == [(1, "run", 5, 11, 30, 0.2), (1, "run", 5, 2, 12, 0.9), (1, "run", 6, 0, 10, 0.5), (1, "sit", None, 1, 10, 0.3)]
    assert len(got(merge=False)) == 6 and tracker.assign_activities(df.limit(0)).collect() == []


def test_union_of_two_scenes(spark):
    k = lambda rows: spark.createDataFrame([(1, t, c, f, tuple(map(float, b))) for t, c, f, b in rows], "video_id long, track_id long, category string, frame int, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    acts = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "video_id long, activity_id long, category string, startframe int, endframe int, track_ids array<long>")
    p = [(1, "p1", 0, (10, 20, 40, 60)), (1, "p1", 2, (20, 30, 60, 80)), (2, "p2", 1, (10, 20, 40, 60)), (2, "p2", 3, (30, 40, 80, 100))]
    same = [(t + 10, c, f, b) for t, c, f, b in p]
    keys, joined = C.union(k(p), acts([(1, "act1", 0, 3, [1, 2])]), k(same), acts([(11, "act1", 0, 3, [12, 11])]))
    assert {(r["track_id"], r["frame"]) for r in keys.collect()} == {(1, 0), (1, 2), (2, 1), (2, 3)} and [r["activity_id"] for r in joined.collect()] == [1]
    other = C.union(k(p), acts([(1, "act1", 0, 3, [1, 2])]), k(same), acts([(11, "act2", 0, 3, [11, 12])]))[1]
    assert {(r["category"], tuple(r["track_ids"])) for r in other.collect()} == {("act1", (1, 2)), ("act2", (1, 2))}
    far = [(13, "p1", 0, (200, 200, 220, 220)), (13, "p1", 2, (200, 200, 220, 220)), (14, "p9", 0, (10, 20, 40, 60)), (14, "p9", 2, (20, 30, 60, 80))]
    keys, joined = C.union(k(p), acts([(1, "act1", 0, 4, [1])]), k(far), acts([(11, "act1", 3, 9, [13])]))
    assert {r["track_id"] for r in keys.collect()} == {1, 2, 13, 14} and len(joined.collect()) == 2
    part = [(15, "p1", 0, (12, 20, 42, 60))]
    for overlap, x in (("average", 10), ("keep", 10), ("replace", 10)):  # one common frame is no span: nothing is merged
        got = {(r["track_id"], r["frame"]): r["box"]["xmin"] for r in C.union(k(p), acts([]), k(part), acts([]), overlap=overlap)[0].collect()}
        assert got[1, 0] == x and got[15, 0] == 12
    shifted = [(16, "p1", f, (b[0] + 2, *b[1:])) for t, c, f, b in p if t == 1]
    for overlap, x in (("average", 11), ("keep", 10), ("replace", 12)):
        got = {(r["track_id"], r["frame"]): r["box"]["xmin"] for r in C.union(k(p), acts([]), k(shifted), acts([]), overlap=overlap)[0].collect()}
        assert got[1, 0] == x and len(got) == 4
