"""Exact selection of the rows with the smallest keys, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of the hash that say into which of 2**BITS slices of its group a row falls.
BITS = 12


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the values of cols and seed only."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def hash_rank(df: DataFrame, group: list[str], key: str, rank: str = "rank", bits: int = BITS) -> DataFrame:
    """Adds `rank`: 1, 2, 3, ... within each group by a hash of the unique column `key`.

    A window over the group alone would put a hot group into one task. Here the hash is cut into
    2**bits slices; slice sizes are counted with map-side combine, their running sums give each
    slice its offset, and only rows of the same slice are ordered against each other.
    """
    h = F.xxhash64(F.col(key))
    df = df.withColumn("_h", h).withColumn("_slice", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    sizes = df.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_slice_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_slice_rows").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_slice").orderBy("_h", key)
    ranked = df.withColumn("_r", F.row_number().over(inner))
    return ranked.join(offsets, [*group, "_slice"]).withColumn(rank, F.col("_before") + F.col("_r")).drop("_h", "_slice", "_r", "_before")


def smallest(df: DataFrame, order: str, tie: str, n: int, steps: int = 4096) -> DataFrame:
    """The n rows with the smallest positive double `order` (ties: smaller `tie`).

    Rows are counted in slices of equal width of log2(order); slices that lie wholly below the
    n-th row pass, the one slice that holds it is ranked. Nothing but the slice sizes (at most
    2100 * steps, in practice some thousands) comes to the driver. n >= rows keeps all rows.
    """
    if n <= 0:
        return df.limit(0)
    df = df.withColumn("_slice", F.floor(F.log2(F.greatest(F.col(order), F.lit(1e-300))) * steps))
    sizes = sorted((r["_slice"], r["n"]) for r in df.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect())
    left, edge = n, None
    for s, k in sizes:
        if k > left:
            edge = s
            break
        left -= k
    if edge is None:
        return df.drop("_slice")
    inside = df.where(F.col("_slice") < edge).drop("_slice")
    if left == 0:
        return inside
    at_edge = df.where(F.col("_slice") == edge).orderBy(order, tie).limit(left).drop("_slice")
    return inside.unionByName(at_edge)


def smallest_per_group(df: DataFrame, group: str, order: str, tie: str, limits: DataFrame, limit: str, steps: int = 64) -> DataFrame:
    """Of each group of `limits` (group, limit) the `limit` rows with the smallest positive double
    `order` (ties: smaller `tie`); other groups give none.

    As in `smallest`, groups are cut into slices of equal width of log2(order) and counted with
    map-side combine; running sums over a group's slices tell which slices pass as a whole, and only
    the slice that holds a group's last row is ranked, by itself. A hot group is never in one task.
    """
    slice_ = F.floor(F.log2(F.greatest(F.col(order), F.lit(1e-300))) * steps)
    rows = df.withColumn("_slice", slice_)
    sizes = rows.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    need = sizes.join(limits, group).where(F.col("_before") < F.col(limit))
    need = need.select(group, "_slice", (F.col(limit) - F.col("_before")).alias("_left"), (F.col(limit) - F.col("_before") < F.col("_rows")).alias("_edge"))
    met = rows.join(need, [group, "_slice"])
    at_edge = met.where("_edge").withColumn("_r", F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order, tie))).where("_r <= _left").drop("_r")
    return met.where("not _edge").unionByName(at_edge).drop("_slice", "_left", "_edge")
