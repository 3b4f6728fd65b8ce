"""Problem 5: a sample whose shares of categories and tags match given targets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import load_names, squeeze_text
from framelake.operators.live import latest
from framelake.operators.selection import smallest, smallest_per_group, uniform
from framelake.session import cut
from framelake.sources.tables import table

#: Sweeps of proportional fitting and the largest deviation of a share at which they stop early.
SWEEPS, CLOSE = 30, 0.002
#: No single weight factor leaves this range, so that targets no data can meet do not blow up the rest.
FACTOR_RANGE = (1e-4, 1e4)
#: Profiles of rows (sets of targets they count for) that the driver rakes by itself; more are raked in tasks.
HELD_PROFILES = 100_000


@dataclass(frozen=True)
class Target:
    field: str  # 'category' (one value a row) or 'tag' (any number of values a row)
    key: str
    code: int  # -1: a name no row can have
    share: float
    permille: int
    min_rows: int


def rake(cells: DataFrame, targets: list[Target], sweeps: int = SWEEPS) -> list[float]:
    """Weight factors by iterative proportional fitting over the margins; place 0 is the rest.

    cells: ids, n. `ids` of a profile are the places (from 1) of the targets it counts for, and 0 if
    its category has no target; n is its rows. One margin is the category with all its targets and
    the rest; each tag is a margin of two values, with and without. A sweep fits the category margin
    exactly and each tag from the same sums; because tags are fitted side by side, their step is
    damped by a square root. One pass over the cells a sweep; one sum a target comes to the driver.
    Up to HELD_PROFILES cells are fetched once and summed there, by the same code.
    """
    held = None
    if cells.limit(HELD_PROFILES + 1).count() <= HELD_PROFILES:
        held = cells.select("ids", "n").toArrow().combine_chunks().to_batches()
    is_cat = np.array([True] + [t.field == "category" for t in targets])
    live = np.array([True] + [t.code >= 0 and t.share > 0 for t in targets])
    share = np.array([0.0] + [t.share for t in targets])
    share[0] = max(0.001, 1 - share[is_cat & live].sum())
    share[is_cat & live] /= share[is_cat & live].sum()
    factor = np.ones(len(share))
    for _ in range(sweeps):
        total, got = _sums(held, factor) if held is not None else _margin_sums(cells, factor)
        if total <= 0:
            break
        now = got / total
        fit = live & (now > 0)
        cat, tag = fit & is_cat, fit & ~is_cat & (now < 1) & (share < 1)
        bound = (factor <= FACTOR_RANGE[0]) | (factor >= FACTOR_RANGE[1])
        off = np.abs(now - share)[(cat | tag) & ~bound]
        if not len(off) or off.max() < CLOSE:
            break
        factor[cat] *= share[cat] / now[cat]
        factor[tag] *= np.sqrt(share[tag] / (1 - share[tag]) * (1 - now[tag]) / now[tag])
        factor = np.clip(factor, *FACTOR_RANGE)
    return [float(f) for f in factor]


def _sums(batches: Iterable[pa.RecordBatch], factor: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight of all rows, and of those that count for each target."""
    logs = np.log(factor)
    sums, total = np.zeros(len(logs)), 0.0
    for b in batches:
        ids = b.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(ids.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        w = np.exp(np.bincount(owner, weights=logs[flat], minlength=len(sizes))) * b.column("n").to_numpy()
        sums += np.bincount(flat, weights=w[owner], minlength=len(logs))
        total += float(w.sum())
    return total, sums


def _margin_sums(cells: DataFrame, factor: np.ndarray) -> tuple[float, np.ndarray]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = _sums(batches, factor)
        yield pa.RecordBatch.from_pydict({"id": pa.array([-1, *range(len(sums))], pa.int32()), "s": pa.array([total, *sums], pa.float64())})

    rows = cells.mapInArrow(part, "id int, s double").groupBy("id").agg(F.sum("s").alias("s")).collect()
    got = {r["id"]: r["s"] for r in rows}
    return got.get(-1, 0.0), np.array([got.get(i, 0.0) for i in range(len(factor))])


def target_ids(targets: list[Target]) -> Column:
    """Places of the targets that a row's `code` and `codes` count for; 0 first where no category target does."""
    cats = [(t.code, i + 1) for i, t in enumerate(targets) if t.field == "category" and t.code >= 0]
    tags = [(t.code, i + 1) for i, t in enumerate(targets) if t.field == "tag" and t.code >= 0]
    look = lambda pairs, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), c) if pairs else F.lit(None).cast("int")
    own = F.array(F.coalesce(look(cats, F.coalesce("code", F.lit(-1))), F.lit(0)))
    return F.concat(own, F.array_sort(F.filter(F.transform("codes", lambda c: look(tags, c)), lambda x: x.isNotNull())))


def matched_sample(rows: DataFrame, key: str, targets: list[Target], size: int, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of rows with `key` (unique), `code` (category or null) and `codes` (tags).

    The sample holds the `size` rows with the smallest exponential keys -ln(u) / weight, u a hash of
    the key: a weighted sample without replacement, the same in every run. Then it is repaired: for
    each target with fewer than min_rows rows in it, the next rows with that value are added until
    the minimum is met or the rows run out; of a target that all rows together cannot meet, all are
    taken (so the sample may exceed `size` by at most the sum of the required rows).

    The report has one row a target: field_name, key_name, required (max of min_rows and
    floor(permille * size / 1000)), available (rows that have the value), sampled, residual =
    required - sampled where positive, and exhausted: the sample holds every row there is and still
    falls short, so the target cannot be met. Null categories and empty tag lists take part with
    weight 1 for those margins. An empty input gives an empty sample and a report of zeros.
    """
    spark = rows.sparkSession
    rows = rows.select(key, "code", "codes", target_ids(targets).alias("ids"))
    cells = cut(rows.groupBy("ids").agg(F.count(F.lit(1)).alias("n")))
    factors = F.array(*[F.lit(f) for f in rake(cells, targets)])
    weight = F.aggregate("ids", F.lit(1.0), lambda w, i: w * F.element_at(factors, i + 1))
    keyed = cut(rows.withColumn("k", -F.ln(uniform(F.col(key), seed=seed)) / weight))
    chosen = cut(smallest(keyed, "k", key, size))

    count = lambda df, n: {r["i"]: r["m"] for r in df.select(F.explode("ids").alias("i"), n.alias("n")).groupBy("i").agg(F.sum("n").alias("m")).collect()}
    have, got = count(cells, F.col("n")), count(chosen, F.lit(1))
    required = {i: max(t.min_rows, t.permille * size // 1000) for i, t in enumerate(targets, 1)}
    goal = {i: required[i] if have.get(i, 0) < required[i] else t.min_rows for i, t in enumerate(targets, 1)}
    short = [(i, goal[i] - got.get(i, 0)) for i in goal if min(goal[i], have.get(i, 0)) > got.get(i, 0)]
    sample = chosen
    if short:
        lacking = spark.createDataFrame(short, "i int, lack long")
        outside = keyed.where(F.arrays_overlap("ids", F.array(*[F.lit(i) for i, _ in short]))).join(chosen.select(key), key, "left_anti")
        outside = outside.select(key, "code", "codes", "ids", "k", F.explode("ids").alias("i"))
        added = smallest_per_group(outside, "i", "k", key, lacking, "lack").drop("i").dropDuplicates([key])
        sample = cut(chosen.unionByName(added))
    got = count(sample, F.lit(1))
    lines = [(t.field, t.key, required[i], have.get(i, 0), got.get(i, 0), max(0, required[i] - got.get(i, 0)), got.get(i, 0) == have.get(i, 0) and got.get(i, 0) < required[i]) for i, t in enumerate(targets, 1)]
    report = spark.createDataFrame(lines, "field_name string, key_name string, required long, available long, sampled long, residual long, exhausted boolean")
    return sample.select(key, "code", "codes"), report


def read_targets(df: DataFrame, code_of: dict[str, int]) -> list[Target]:
    """The targets in order of their names; they are parameters of the plan, held by the driver."""
    rows = df.where("field_name is not null and key_name is not null").collect()
    rows = sorted(rows, key=lambda r: (r["field_name"], r["key_name"]))
    return [Target(r["field_name"], r["key_name"], code_of.get(squeeze_text(r["key_name"]), -1), (r["target_permille"] or 0) / 1000, r["target_permille"] or 0, r["min_rows"] or 0) for r in rows]


def image_sample(spark: SparkSession, d: str):
    names = load_names(table(spark, d, "category_ref"))
    targets = read_targets(table(spark, d, "sample_target"), names.code_of)
    live = cut(latest(table(spark, d, "image"), "image_id", "ingested_at", {"code": names.code("category"), "codes": names.codes("tags")}))
    sample, report = matched_sample(live, "image_id", targets, live.count() // 10)
    return names, sample, report


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that cannot be met: the raked and repaired sample holds all their rows and falls short."""
    _, _, report = image_sample(spark, d)
    return report.where("exhausted").select("field_name", "key_name")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return image_sample(spark, d)[2]


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    names, sample, _ = image_sample(spark, d)
    return sample.select("image_id", names.name("code").alias("category"))


def p5_minimums(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether the sample holds its minimum or, where there are fewer, all its rows."""
    return image_sample(spark, d)[2].join(table(spark, d, "sample_target").select("field_name", "key_name", "min_rows"), ["field_name", "key_name"]).select("field_name", "key_name", (F.col("sampled") >= F.least("min_rows", "available")).alias("met"))


def p5_available(spark: SparkSession, d: str) -> DataFrame:
    """Per target: rows that are required and rows that have the value."""
    return image_sample(spark, d)[2].select("field_name", "key_name", "required", "available")
