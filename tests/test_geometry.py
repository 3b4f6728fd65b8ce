import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators import detections as D


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_golden_thresholds(spark):
    a = B.box(0, 0, 10, 20)
    b = B.grow(a, right=10)
    assert one(spark, B.cover(b, a)) == 0.5 and one(spark, B.cover(a, b)) == 1.0 and one(spark, B.iou(a, b)) == 0.5
    assert not one(spark, B.has_intersection(b, a, at_cover=0.8))
    assert one(spark, B.has_intersection(b, a, at_bbcover=0.8))
    assert not one(spark, B.has_intersection(a, b, at_iou=0.51))
    assert one(spark, B.has_intersection(a, b, at_iou=0.5))
    assert not one(spark, B.has_intersection(a, B.box(10, 20, 20, 40)))


def test_constructors_and_nulls(spark):
    s = B.from_strings(*[F.lit(x) for x in ("0", "0.5", "1E2", "10.2")])
    assert tuple(one(spark, s)) == (0.0, 0.5, 100.0, 10.2)
    assert tuple(one(spark, B.from_centroid(5, 5, 10, 4))) == (0, 3, 10, 7)
    mask = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ([0, 0, 0], [0, 1, 1], [0, 0, 0])])
    assert tuple(one(spark, B.from_mask(mask))) == (1, 1, 3, 2)
    assert not one(spark, B.valid(B.box(F.lit(float("nan")), 0, 1, 1))) and one(spark, B.valid(B.box(1, 1, 1, 1)))
    assert one(spark, B.iou(B.box(0, 0, 0, 0), B.box(0, 0, 0, 0))) == 0


def test_there_and_back(spark):
    b = B.box(3.5, 2.25, 17, 9)
    for f in (lambda x: B.fliplr(B.fliplr(x, 64), 64), lambda x: B.flipud(B.flipud(x, 48), 48), lambda x: B.rescale(B.rescale(x, 4), 0.25), lambda x: B.rot90ccw(B.rot90cw(x, 48, 64), 64, 48)):
        assert tuple(one(spark, f(b))) == tuple(one(spark, b))
    assert tuple(one(spark, B.rounded(B.box(0.5, 1.5, 3, 4.1)))) == (0, 2, 2, 5)


def objects(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.randrange(300), rnd.randrange(200)
        rows.append((rnd.choice([1, 1, 1, 2]), i, rnd.choice("ab"), rnd.randrange(1, 20) / 20, (float(x), float(y), float(x + rnd.randrange(5, 90)), float(y + rnd.randrange(5, 90)))))
    schema = "image_id long, id long, category string, conf double, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return rows, spark.createDataFrame(rows, schema)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = w * h if w > 0 and h > 0 else 0
    s = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return i / (s(a) + s(b) - i), max(i / s(a), i / s(b))


@pytest.mark.parametrize("by", [None, "category"])
def test_nms_is_the_sequential_one(spark, by):
    rows, df = objects(spark)
    keep = []
    for r in sorted((r for r in rows if r[3] > 0.2), key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and (by is None or k[2] == r[2]) and (iou(k[4], r[4])[0] >= 0.3 or iou(k[4], r[4])[1] > 0.8) for k in keep):
            keep.append(r)
    for most in (D.PASS_PAIRS, 20, 0):  # in one pass, one image in rounds, all in rounds
        got = D.nms(df, "image_id", "id", "conf", 0.2, 0.3, 0.8, by, cell=50.0, most_pairs=most)
        assert sorted(r["id"] for r in got.collect()) == sorted(r[1] for r in keep)


def test_assignment_is_the_sequential_one(spark):
    rows, df = objects(spark, 160, 5)
    src, dst = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    area = lambda r: (r[4][2] - r[4][0]) * (r[4][3] - r[4][1])
    taken, want = set(), {}
    for s in sorted(src, key=lambda r: (-area(r), r[1])):
        free = [(iou(s[4], d[4])[0], -d[1]) for d in dst if d[0] == s[0] and d[1] not in taken]
        if free and max(free)[0] > 0.05:
            want[s[1]] = -max(free)[1]
            taken.add(-max(free)[1])
    got = D.assign_boxes(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "image_id", "id", 0.05, cell=50.0)
    assert {r["src"]: r["dst"] for r in got.collect()} == want
    edges = D.grid_join(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["image_id"], 50.0).select("image_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), B.area(F.col("a_box")).alias("area"), B.iou(F.col("a_box"), F.col("b_box")).alias("iou")).where("iou > 0.05")
    for most in (30, 0):
        got = D.greedy_assignment(edges, "image_id", "src", "dst", F.col("area"), F.col("iou"), most)
        assert {r["src"]: r["dst"] for r in got.collect()} == want
    assert D.difference(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "image_id", "id", 0.05).count() == len(src) - len(want)


def test_grid_join_finds_every_pair_once(spark):
    rows, df = objects(spark)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a[4], b[4])[0] > 0}
    for cell in (7.0, 64.0, 1000.0):
        got = [(r["a_id"], r["b_id"]) for r in D.pair_overlaps(df, "image_id", "id", cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
