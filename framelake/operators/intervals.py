"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.tables import small_enough

#: Distinct starts of one entity that a single task should sort.
BLOCK_ROWS = 500_000


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Periods and gaps of half-open intervals [start, end) per entity.

    Method: sort by start per entity, compare each start with the running maximum of the ends
    before it, open an island where the start lies beyond it, aggregate islands to periods; the
    step from that maximum to the start of the new island is the gap.

    Result: entity columns, kind ('period' or 'gap'), start, end. Intervals that overlap or touch
    make one period. Defined cases: a null entity column groups like a value; intervals with a
    null end or with end <= start are left out; repeats and ties change nothing; an empty input
    gives an empty result; other columns of df are ignored, whatever their names.

    Scale: equal starts are combined map-side first. An entity with more than block_rows distinct
    starts is cut into blocks of its own time line, so that its rows are sorted by many tasks; what
    a block needs of earlier ones (largest end so far) is one number a block.
    """
    e = [f"_e{i}" for i in range(len(entity))]
    spans = (
        df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
        .select(*[F.col(c).alias(x) for c, x in zip(entity, e)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_t"))
        .groupBy(*e, "_s")
        .agg(F.max("_t").alias("_t"))
    )
    # Entities whose starts exceed one block; at most rows / block_rows of them.
    large = (
        spans.groupBy(*e)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("_from"), F.max("_s").alias("_to"))
        .where(F.col("n") > block_rows)
        .select(*e, "_from", (F.floor((F.col("_to") - F.col("_from")) / F.ceil(F.col("n") / block_rows)) + 1).alias("_width"))
    )
    large = large.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(e)], "_from", "_width")
    same = None
    for i, c in enumerate(e):
        hit = F.col(c).eqNullSafe(F.col(f"_l{i}"))
        same = hit if same is None else same & hit
    side = F.broadcast(large) if small_enough(large, 8 << 20) else large
    blocks = spans.join(side, same, "left").select(*e, "_s", "_t", F.when(F.col("_width").isNotNull(), F.floor((F.col("_s") - F.col("_from")) / F.col("_width"))).otherwise(F.lit(0)).alias("_b"))

    # What earlier blocks of the entity reach, one row a block.
    reach = blocks.groupBy(*e, "_b").agg(F.max("_t").alias("_m"))
    earlier = Window.partitionBy(*e).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.select(*e, "_b", F.max("_m").over(earlier).alias("_carry")).where(F.col("_carry").isNotNull())
    carry = carry.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(e)], F.col("_b").alias("_cb"), "_carry")
    on = F.col("_b") == F.col("_cb")
    for i, c in enumerate(e):
        on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    before = Window.partitionBy(*e, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        blocks.withColumn("_local", F.max("_t").over(before))
        .join(carry, on, "left")
        .select(*e, "_b", "_s", "_t", F.greatest("_local", "_carry").alias("_reach"))
    )
    opened = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), F.col("_s")))
    # Label of the island: the start that opened it; a block's first rows may belong to an earlier block's.
    upto = Window.partitionBy(*e, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    labelled = opened.withColumn("_island", F.last("_new", ignorenulls=True).over(upto))
    islands = labelled.groupBy(*e, "_b", "_island").agg(F.max("_t").alias("_t"), F.max(F.when(F.col("_new").isNotNull(), F.col("_reach"))).alias("_gap"))
    # Rows before a block's first opening belong to the island opened last in the blocks before: one label a block.
    last = islands.groupBy(*e, "_b").agg(F.max("_island").alias("_last"))
    open_before = last.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(e)], F.col("_b").alias("_pb"), F.max("_last").over(earlier).alias("_open"))
    on = F.col("_b") == F.col("_pb")
    for i, c in enumerate(e):
        on = on & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    headless = islands.where(F.col("_island").isNull()).join(open_before, on).select(*e, F.col("_open").alias("_island"), "_t", "_gap")
    periods = (
        islands.where(F.col("_island").isNotNull())
        .select(*e, "_island", "_t", "_gap")
        .unionByName(headless)
        .groupBy(*e, "_island")
        .agg(F.max("_t").alias("_t"), F.max("_gap").alias("_gap"))
    )
    parts = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_island").alias("s"), F.col("_t").alias("t")),
        F.struct(F.lit("gap").alias("kind"), F.col("_gap").alias("s"), F.col("_island").alias("t")),
    )
    out = periods.select(*e, F.explode(parts).alias("p")).where(F.col("p.s").isNotNull())
    kinds = dict(df.dtypes)
    return out.select(
        *[F.col(x).alias(c) for c, x in zip(entity, e)],
        F.col("p.kind").alias("kind"),
        F.col("p.s").cast(kinds[start]).alias(start),
        F.col("p.t").cast(kinds[end]).alias(end),
    )
