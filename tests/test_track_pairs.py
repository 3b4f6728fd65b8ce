import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators import tracks as K


@pytest.fixture(scope="module")
def scene(spark):
    """70 tracks of one video with spans and sizes of all kinds, and the same a little aside, cut or far away."""
    draw, rows = np.random.default_rng(7), []
    for t in range(70):
        frames = np.sort(draw.choice(np.arange(draw.integers(0, 150), draw.integers(300, 420)), draw.integers(2, 40), replace=False))
        w, h = draw.uniform(15, 60, 2)
        rows += [(1, t, int(f), float(draw.uniform(0, 60)), float(draw.uniform(0, 40)), float(w), float(h), 0.5) for f in frames]
    k = spark.createDataFrame(rows, "video_id long, track_id long, frame int, x double, y double, w double, h double, conf double")
    k = k.select("video_id", "track_id", "frame", B.from_xywh("x", "y", "w", "h").alias("box"), "conf").cache()
    part = k.where("frame between 100 and 300")
    move = lambda by, dx: part.withColumn("track_id", F.col("track_id") + by).withColumn("box", B.translate(F.col("box"), dx, 0))
    return k, move(1000, 0.25).unionByName(move(2000, 500)).unionByName(move(3000, 12))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_covers_above_a_bound_are_those_of_all_pairs(scene):
    a, b = scene
    want = rows(K.segment_metrics(a, other=b).where("percentile_cover > 0.6"))
    assert len(want) > 60 and rows(K.segment_metrics(a, other=b, least=0.6)) == want


def dense(keys):
    """{track: (first frame, boxes by frame)}"""
    out = {}
    for r in sorted(keys.collect(), key=lambda r: (r["track_id"], r["frame"])):
        out.setdefault(r["track_id"], []).append((r["frame"], *r["box"]))
    for t, k in out.items():
        k = np.array(k)
        at = np.arange(k[0, 0], k[-1, 0] + 1)
        out[t] = int(k[0, 0]), np.stack([np.interp(at, k[:, 0], k[:, c]) for c in range(1, 5)])
    return out


def overlaps(a, b):
    """(first common frame, IoU by common frame) of two tracks."""
    s, e = max(a[0], b[0]), min(a[0] + a[1].shape[1], b[0] + b[1].shape[1])
    x, y = a[1][:, s - a[0] : e - a[0]], b[1][:, s - b[0] : e - b[0]]
    side = lambda i: np.maximum(0, np.minimum(x[i + 2], y[i + 2]) - np.maximum(x[i], y[i]))
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    inter = side(0) * side(1)
    return inter / (area(x) + area(y) - inter)


def test_segment_metrics_of_large_blocks(scene):
    """Few shuffled copies: a track goes to as many pairs of blocks as there are blocks, whatever its video's tracks."""
    k, d = scene[0], dense(scene[0])
    got = {(r["a_track"], r["b_track"]): r for r in K.segment_metrics(k).collect()}
    want = {}
    for a in d:
        for b in d:
            if a < b and min(a_b[0] + a_b[1].shape[1] for a_b in (d[a], d[b])) - 1 > max(d[a][0], d[b][0]):
                want[a, b] = overlaps(d[a], d[b])
    assert got.keys() == want.keys()
    for p, i in want.items():
        e = len(i) - 1
        even = i[[*range(0, e, max(1, e // 100)), e]]
        best = np.sort(even)[::-1][: max(1, int(len(even) * 0.8))].mean()
        assert abs(got[p]["segment_iou"] - i[:e:5].mean()) < 1e-9 and abs(got[p]["endpoint_iou"] - (i[0] + i[e]) / 2) < 1e-9 and abs(got[p]["percentile_iou"] - best) < 1e-9
    many = k.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("track_id", F.col("track_id") + 100 * F.col("n")).drop("n")
    assert K._blocks(many, ["video_id"]).select("block").distinct().count() <= 8


def test_pairs_above_a_smallest_iou_are_those_of_all_pairs(scene):
    k = scene[0].unionByName(scene[1])
    want = rows(K.pair_metrics(k, []).where("min_iou > 0"))
    assert len(want) > 60 and rows(K.pair_metrics(k, [], least=0.0)) == want
    assert rows(K.pair_metrics(k, [], least=0.8)) == [r for r in want if r[6] > 0.8]


def test_pair_metrics_of_sources_and_targets(scene):
    k = scene[0]
    odd = F.col("track_id") % 2 == 1
    got = rows(K.pair_metrics(k.where(odd), [], other=k.where(~odd)))
    want = [r if r[1] % 2 else (r[0], r[2], r[1], *r[3:]) for r in rows(K.pair_metrics(k, [])) if (r[1] + r[2]) % 2]
    assert got == sorted(want)


def sampled(i, step=5, share=0.8, samples=100):
    """segment mean, ends' mean, smallest and mean of the best share of a pair's values by common frame."""
    e = len(i) - 1
    even = i[[*range(0, e, max(1, e // samples)), e]]
    best = np.sort(even)[::-1][: max(1, int(len(even) * share))].mean()
    return i[:e:step].mean(), (i[0] + i[e]) / 2, i[:e:step].min(), best


def covers(a, b):
    s, e = max(a[0], b[0]), min(a[0] + a[1].shape[1], b[0] + b[1].shape[1])
    x, y = a[1][:, s - a[0] : e - a[0]], b[1][:, s - b[0] : e - b[0]]
    side = lambda i: np.maximum(0, np.minimum(x[i + 2], y[i + 2]) - np.maximum(x[i], y[i]))
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    return side(0) * side(1) / np.minimum(area(x), area(y))


def test_segment_metrics_come_whole_from_the_blocks(scene):
    """All six, of one set of tracks and of two, against plain loops; no pair is joined once more for its spans."""
    k = scene[0].unionByName(scene[1].where("track_id < 1030 or track_id between 3000 and 3020"))
    d, apart, close = dense(k), 0, 0
    for other in (None, scene[1]):
        of = d if other is None else dense(other)
        found = K.segment_metrics(k, other=other)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.partition("FlatMapGroupsInArrow")[0]
        got = {(r["a_track"], r["b_track"]): r[3:] for r in found.collect()}
        end = lambda t: t[0] + t[1].shape[1] - 1
        want = {(a, b) for a in d for b in of if (a < b or other is not None) and min(end(d[a]), end(of[b])) > max(d[a][0], of[b][0])}
        assert got.keys() == want
        for a, b in want:
            x, y = d[a], of[b]
            within = (x[0] >= y[0] and end(x) <= end(y)) or (y[0] >= x[0] and end(y) <= end(x))
            i, c = sampled(overlaps(x, y)), sampled(covers(x, y))
            assert np.allclose(got[a, b], (i[0], c[0], i[1], i[2] if within else 0, i[3], c[3]), rtol=0, atol=1e-9)
            apart, close = apart + (i[3] == 0), close + (within and i[2] > 0)
    assert apart > 100 and close > 100


def test_sums_over_all_frames_of_a_window(scene):
    """Sums of tracks cut by the window of two blocks, also those of no area, and the pairs that are still to be measured."""
    keys = sorted(scene[0].collect(), key=lambda r: (r["track_id"], r["frame"]))
    tracks = {t: [r for r in keys if r["track_id"] == t] for t in {r["track_id"] for r in keys}}
    flat = lambda t, c: [r["box"][c] if t % 9 else r["box"]["xmin" if c[0] == "x" else "ymin"] for r in tracks[t]]
    table = lambda ts: pa.table({"track_id": ts, "lo": [tracks[t][0]["frame"] for t in ts], "hi": [tracks[t][-1]["frame"] for t in ts], "at": [[r["frame"] for r in tracks[t]] for t in ts], **{c: [flat(t, c) for t in ts] for c in K.CORNERS}})
    start, end = 90, 350
    side = K._Side(table([t for t in tracks if tracks[t][0]["frame"] <= end and tracks[t][-1]["frame"] >= start]), start, end)
    with np.errstate(divide="ignore", invalid="ignore"):
        iou, cover = K._overlaps(side.box[:, :, None], side.box[:, None])
    got = {}
    for i, j, sums, meets in K._sums(side, side, True):
        got |= {(a, b): (*s, m) for a, b, s, m in zip(i.tolist(), j.tolist(), sums.T, meets)}
    n = len(side.lo)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if max(side.lo[i], side.lo[j]) <= min(side.hi[i], side.hi[j])}
    assert got.keys() == want and len(want) > 1000
    for (i, j), g in got.items():
        assert np.allclose(g, (iou[i, j].sum(), cover[i, j].sum(), iou[i, j].max(), np.count_nonzero(iou[i, j])), rtol=0, atol=1e-9)


def test_only_key_boxes_of_common_frames_travel(spark):
    at = [2, 10, 20, 30, 40, 55]
    rows = [(2, 55, s, e, at, *[[float(f + c) for f in at] for c in range(4)]) for s, e in ((0, 60), (12, 35), (20, 30), (22, 27), (0, 9), (50, 60))]
    w = spark.createDataFrame(rows, "lo int, hi int, start int, end int, at array<int>, " + ", ".join(f"{c} array<double>" for c in K.CORNERS))
    got = [tuple(r) for r in w.select(*K._needed()).collect()]
    assert [r[0] for r in got] == [at, [10, 20, 30, 40], [20, 30], [20, 30], [2, 10], [40, 55]]
    assert all(r[1 + c] == [f + c for f in r[0]] for r in got for c in range(4))
