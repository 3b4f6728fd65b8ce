"""Sets of detections in an image: suppression, assignment and set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import box as B
from framelake.operators.joins import grid_join
from framelake.session import cut

#: Side of a grid cell in pixels.
CELL = 128.0
#: Rounds after which a resolution that has not settled is an error.
MOST_ROUNDS = 1000
#: Pairs of one image that are resolved in a single pass of one task; images with more go in rounds over all tasks.
PASS_PAIRS = 1_000_000


def _by_size(edges: DataFrame, group: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(edges of groups with at most `most` of them, edges of the others)."""
    large = cut(edges.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(group))
    return edges.join(large, group, "left_anti"), edges.join(large, group, "left_semi")


def _in_order(edges: DataFrame, group: str, order: list[Column], out: str, begin: Callable[[], Callable[[tuple], tuple | None]]) -> DataFrame:
    """Edges (group first) in order within their group, each through the step that begin() makes for its
    group; what the steps give are the rows. Tasks read sorted rows and hold a step's memory of one group."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.repartition(tasks, group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = object(), None
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != own:
                    own, step = row[0], begin()
                got = step(row)
                if got is not None:
                    found.append(got)
            n = len(found[0]) if found else 0
            kinds = [b.schema.field(i).type for i in range(n)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(n)], [b.schema.names[i] for i in range(n)])

    return rows.mapInArrow(run, out)


def pair_overlaps(objects: DataFrame, image: str, obj: str, by: list[str] | None = None, cell: float = CELL) -> DataFrame:
    """Overlapping pairs within an image, a_<obj> < b_<obj>, with iou, cover, maxcover and shape_iou."""
    pairs = grid_join(objects, objects, [image, *(by or [])], cell, only=F.col(f"a_{obj}") < F.col(f"b_{obj}"))
    a, b = F.col("a_box"), F.col("b_box")
    return pairs.withColumns({"iou": B.iou(a, b), "cover": B.cover(a, b), "maxcover": B.max_cover(a, b), "shape_iou": B.shape_iou(a, b)})


def nms(objects: DataFrame, image: str, obj: str, conf: str, min_conf: float, iou: float, cover: float | None = None, by: str | None = None, cell: float = CELL, most_pairs: int = PASS_PAIRS) -> DataFrame:
    """Greedy non-maximum suppression: the detections that stay.

    Detections above min_conf with a valid box, in order of confidence (ties: smaller `obj`), suppress
    later ones that overlap with iou >= `iou` or maxcover > `cover` (of the same `by`). The close pairs
    of an image are read in order of the stronger one, which has fallen by then if it ever does. Images
    with more than PASS_PAIRS pairs go in rounds over all tasks instead: a detection stays when every
    stronger neighbour is suppressed, and falls when one stays; rounds are as many as the longest
    chain of neighbours. Both give the same.
    """
    keep = objects.where((F.col(conf) > min_conf) & B.valid(F.col("box")))
    slim = keep.select(image, obj, conf, "box", *([by] if by else []))
    pairs = grid_join(slim, slim, [image, *([by] if by else [])], cell, only=F.struct(-F.col(f"a_{conf}"), F.col(f"a_{obj}")) < F.struct(-F.col(f"b_{conf}"), F.col(f"b_{obj}")))
    a, b = F.col("a_box"), F.col("b_box")
    close = B.iou(a, b) >= iou
    if cover is not None:
        close = close | (B.max_cover(a, b) > cover)
    edges = cut(pairs.where(close).select(image, F.col(f"a_{obj}").alias("s"), F.col(f"b_{obj}").alias("w"), F.col(f"a_{conf}").alias("_c")))
    few, many = _by_size(edges, image, most_pairs)
    kinds = dict(edges.dtypes)

    def begin() -> Callable[[tuple], tuple | None]:
        down = set()

        def step(row: tuple) -> tuple | None:
            g, stronger, weaker, _ = row
            if stronger in down or weaker in down:
                return None
            down.add(weaker)
            return (g, None, weaker)

        return step

    fallen = _in_order(few, image, [F.desc("_c"), F.col("s"), F.col("w")], f"`{image}` {kinds[image]}, s {kinds['s']}, w {kinds['w']}", begin).select(image, "w")
    left = cut(many.drop("_c"))
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        # Strongest ones still in question: they are nobody's weaker neighbour.
        tops = left.select(image, F.col("s").alias("k")).join(left.select(image, F.col("w").alias("k")), [image, "k"], "left_anti").distinct()
        down = left.join(tops.withColumnRenamed("k", "s"), [image, "s"], "left_semi").select(image, "w").distinct()
        down = cut(down)
        fallen = fallen.unionByName(down)
        gone = down.withColumnRenamed("w", "x")
        left = left.join(tops.withColumnRenamed("k", "s"), [image, "s"], "left_anti")
        left = left.join(gone.withColumnRenamed("x", "s"), [image, "s"], "left_anti")
        left = cut(left.join(gone.withColumnRenamed("x", "w"), [image, "w"], "left_anti"))
    else:
        raise RuntimeError("suppression has not settled")
    return keep.join(fallen.withColumnRenamed("w", obj), [image, obj], "left_anti")


def greedy_assignment(edges: DataFrame, group: str, src: str, dst: str, order: Column, score: Column, most_pairs: int = PASS_PAIRS) -> DataFrame:
    """One-to-one: sources in the order of `order` (largest first; ties: smaller src) each take the free
    destination with the largest score (ties: smaller dst). edges: the pairs that may be matched.

    The pairs of a group are read in that order by one task, which holds what is taken. Groups with
    more than PASS_PAIRS pairs go in rounds over all tasks: all sources ask for their best destination
    at once, a destination keeps the source that comes first in the order and turns the others away
    for good, until nobody is turned away. As all destinations prefer the same order, both give the
    same.
    """
    rows = cut(edges.select(group, src, dst, order.alias("_o"), score.alias("_s")))
    few, left = _by_size(rows, group, most_pairs)
    kinds = dict(rows.dtypes)

    def begin() -> Callable[[tuple], tuple | None]:
        taken, served = set(), set()

        def step(row: tuple) -> tuple | None:
            if row[1] in served or row[2] in taken:
                return None
            served.add(row[1])
            taken.add(row[2])
            return row

        return step

    out = ", ".join(f"`{c}` {kinds[c]}" for c in (group, src, dst, "_o", "_s"))
    done = _in_order(few, group, [F.desc("_o"), F.col(src), F.desc("_s"), F.col(dst)], out, begin).select(group, src, dst, F.col("_s").alias("score"))
    left = cut(left)
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            return done
        asks = left.groupBy(group, src).agg(F.max_by(F.col(dst), F.struct("_s", -F.col(dst))).alias(dst), F.max("_o").alias("_o"))
        holds = asks.groupBy(group, dst).agg(F.max_by(F.struct(F.col(src).alias("hs"), F.col("_o").alias("ho")), F.struct("_o", -F.col(src))).alias("h")).select(group, dst, "h.hs", "h.ho")
        # Whoever comes after the holder of a destination never gets it.
        worse = left.join(holds, [group, dst]).where((F.col("ho") > F.col("_o")) | ((F.col("ho") == F.col("_o")) & (F.col("hs") < F.col(src))))
        worse = cut(worse.select(group, src, dst))
        if worse.isEmpty():
            break
        left = cut(left.join(worse, [group, src, dst], "left_anti"))
    else:
        raise RuntimeError("assignment has not settled")
    return done.unionByName(left.groupBy(group, src).agg(F.max_by(F.col(dst), F.struct("_s", -F.col(dst))).alias(dst), F.max("_s").alias("score")))


def assign_boxes(sources: DataFrame, targets: DataFrame, image: str, obj: str, min_iou: float = 0.0, by: str | None = None, cell: float = CELL) -> DataFrame:
    """(image, src, dst, score): greedy assignment by IoU above min_iou, sources by descending area."""
    pairs = grid_join(sources, targets, [image, *([by] if by else [])], cell)
    a, b = F.col("a_box"), F.col("b_box")
    edges = pairs.select(image, F.col(f"a_{obj}").alias("src"), F.col(f"b_{obj}").alias("dst"), B.area(a).alias("area"), B.iou(a, b).alias("iou")).where(F.col("iou") > min_iou)
    return greedy_assignment(edges, image, "src", "dst", F.col("area"), F.col("iou"))


def intersection(a: DataFrame, b: DataFrame, image: str, obj: str, min_iou: float, by: str | None = None) -> DataFrame:
    """Objects of a that are assigned one of b."""
    hit = assign_boxes(a, b, image, obj, min_iou, by).select(image, F.col("src").alias(obj))
    return a.join(hit, [image, obj], "left_semi")


def difference(a: DataFrame, b: DataFrame, image: str, obj: str, min_iou: float, by: str | None = None) -> DataFrame:
    """Objects of a without one of b."""
    hit = assign_boxes(a, b, image, obj, min_iou, by).select(image, F.col("src").alias(obj))
    return a.join(hit, [image, obj], "left_anti")


def union(a: DataFrame, b: DataFrame, image: str, obj: str, min_iou: float | None = None, by: str | None = None) -> DataFrame:
    """Objects of both; with min_iou, those of b that a has already are left out."""
    extra = b if min_iou is None else difference(b, a, image, obj, min_iou, by)
    return a.unionByName(extra, allowMissingColumns=True)


def any_overlap(a: DataFrame, b: DataFrame, image: str, obj: str, how: str = "left_semi", cell: float = CELL) -> DataFrame:
    """Objects of a that overlap some (left_semi) or no (left_anti) object of b in the image."""
    hit = grid_join(a.select(image, obj, "box"), b.select(image, "box"), [image], cell).select(image, F.col(f"a_{obj}").alias(obj)).distinct()
    return a.join(hit, [image, obj], how)


def clip_to_image(objects: DataFrame, w: str, h: str) -> DataFrame:
    """Boxes cut to the image; objects outside it are left out."""
    return objects.where(B.in_image(F.col("box"), F.col(w), F.col(h))).withColumn("box", B.clip(F.col("box"), F.col(w), F.col(h)))


def to_pixels(objects: DataFrame, flag: str, w: str, h: str) -> DataFrame:
    """Normalized boxes scaled by the image's size; null where that is unknown."""
    scaled = B.rescale(F.col("box"), F.col(w), F.col(h))
    return objects.withColumn("box", F.when(F.coalesce(F.col(flag), F.lit(False)), scaled).otherwise(F.col("box")))


def summary(objects: DataFrame, image: str, obj: str, category: str) -> DataFrame:
    """Per image: number of objects, distinct categories, first and last object, box around all."""
    return objects.groupBy(image).agg(
        F.count(F.lit(1)).alias("n_objects"), F.array_sort(F.collect_set(category)).alias("categories"),
        F.min_by(category, obj).alias("primary_category"), F.max_by(category, obj).alias("last_category"), B.union_agg(F.col("box")).alias("box"),
    )
