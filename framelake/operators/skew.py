"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.session import cut


@dataclass(frozen=True)
class ShardPlan:
    """Where the rows of heavy keys go: key -> (task of each of its shards). Other keys go by hash."""

    tasks: int
    places: dict[object, list[int]]
    loads: list[float]

    def shard(self, key: Column, row: Column) -> Column:
        """Number of the row's shard within its key; 0 for light keys."""
        if not self.places:
            return F.lit(0)
        counts = F.create_map(*[F.lit(x) for k, v in self.places.items() for x in (k, len(v))])
        return F.coalesce(F.pmod(F.xxhash64(row), F.try_element_at(counts, key)).cast("int"), F.lit(0))

    def task(self, key: Column, shard: Column) -> Column:
        """The task that bears a shard."""
        light = F.pmod(F.xxhash64(key), F.lit(self.tasks)).cast("int")
        if not self.places:
            return light
        places = F.create_map(*[x for k, v in self.places.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
        return F.coalesce(F.get(F.try_element_at(places, key), shard), light)


def plan_shards(df: DataFrame, key: str, tasks: int, slack: float = 0.5) -> ShardPlan:
    """Bin-packs the keys of df to `tasks` tasks by their row counts.

    The counts are a map-side combined aggregate. Keys with more than slack/16 of a task's fair share
    come to the driver: at most 16 * tasks / slack of them, whatever the data. Keys above slack of a
    share are split into as many shards of equal size as keep each below it; all shards and whole
    keys go, largest first, to the task with the least load so far. The many keys lighter than that
    are spread by hash, so that no table of all keys is needed.
    """
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return ShardPlan(tasks, {}, [0.0] * tasks)
    share = total / tasks
    heavy = counts.where(F.col("n") > F.lit(share * slack / 16)).collect()
    pieces = []
    for r in heavy:
        n = max(1, -(-int(r["n"]) // max(1, int(share * slack))))
        pieces += [(r["n"] / n, r[key], i) for i in range(n)]
    light = (total - sum(r["n"] for r in heavy)) / tasks
    heap = [(light, t) for t in range(tasks)]
    loads, places = [light] * tasks, {r[key]: [0] * sum(p[1] == r[key] for p in pieces) for r in heavy}
    for load, k, i in sorted(pieces, key=lambda p: (-p[0], str(p[1]), p[2])):
        at, t = heapq.heappop(heap)
        places[k][i] = t
        loads[t] = at + load
        heapq.heappush(heap, (at + load, t))
    return ShardPlan(tasks, places, loads)


def fragment(df: DataFrame, key: str, row: str, plan: ShardPlan) -> DataFrame:
    """Sends every row to its shard's task; adds `_shard` and `_task`. Rows with a null key are left out.

    Windows and aggregates by (_task, key, _shard) run where the rows then lie, without another shuffle.
    """
    out = df.where(F.col(key).isNotNull()).withColumn("_shard", plan.shard(F.col(key), F.col(row)))
    out = out.withColumn("_task", plan.task(F.col(key), F.col("_shard")))
    return out.repartitionById(plan.tasks, "_task")


def replicate(df: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """The matching side: one row for light keys, one for each shard of a heavy key, at the shard's task."""
    n = F.lit(1)
    if plan.places:
        counts = F.create_map(*[F.lit(x) for k, v in plan.places.items() for x in (k, len(v))])
        n = F.coalesce(F.try_element_at(counts, F.col(key)), n)
    out = df.where(F.col(key).isNotNull()).withColumn("_shard", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("_task", plan.task(F.col(key), F.col("_shard"))).repartitionById(plan.tasks, "_task")


def matched(df: DataFrame, side: DataFrame, key: str, row: str, plan: ShardPlan) -> DataFrame:
    """Rows of df beside those of `side` with the same key, where the rows' shards lie.

    Both sides are placed by task, so the join moves nothing more; a heavy key's rows meet the copy
    of its matching side that was sent to their shard. Rows whose key the side lacks are left out.
    """
    copies = replicate(side, key, plan).hint("shuffle_hash")
    return fragment(df, key, row, plan).join(copies, ["_task", key, "_shard"])


def top_per_key(df: DataFrame, key: str, value: str, row: str, k: int, side: DataFrame, tasks: int, loads: DataFrame | None = None) -> DataFrame:
    """The k rows with the largest `value` of every key (ties: smaller `row`) beside the columns of
    the matching side: key, side's other columns, row, value.

    Rows meet their copy of the side in their shard; shards are reduced to k rows each where they
    lie; what is merged per key is k rows a shard. Rows with a null key or value are left out, also
    keys the side lacks; NaN counts as null; a row listed twice for a key counts once; an empty input
    gives an empty result. `side` has one row a key. `loads` is a frame with the same keys from which
    the load is estimated, where that is cheaper than df itself (say, before older deliveries are
    left out); it moves rows between tasks only, never the result.
    """
    from pyspark.sql import Window

    df = df.select(F.col(key).alias("_key"), F.col(row).alias("_row"), F.col(value).alias("_value"))
    df = df.where(F.col("_value").isNotNull() & ~F.isnan(F.col("_value").cast("double")))
    plan = plan_shards(df if loads is None else loads.select(F.col(key).alias("_key")), "_key", tasks)
    other = [c for c in side.columns if c != key]
    rows = matched(df, side.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_side_{c}") for c in other]), "_key", "_row", plan)
    best = [F.col("_value").desc(), F.col("_row")]
    shard = Window.partitionBy("_task", "_key", "_shard").orderBy(*best)
    rows = rows.withColumn("_r", F.dense_rank().over(shard)).where(F.col("_r") <= k)
    rows = rows.dropDuplicates(["_key", "_row", "_value"])
    whole = Window.partitionBy("_key").orderBy(*best)
    rows = rows.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)
    return rows.select(F.col("_key").alias(key), *[F.col(f"_side_{c}").alias(c) for c in other], F.col("_row").alias(row), F.col("_value").alias(value))


def profile_per_key(df: DataFrame, key: str, row: str, value: str, side: DataFrame, tasks: int, loads: DataFrame | None = None) -> DataFrame:
    """Exact per-key statistics of `value` next to the columns of the matching side `side`.

    Result: key, side's other columns, rows, mean, lowest, highest. Rows meet their copy of the side
    in their shard and are reduced there; the final merge sees one row a shard. Rows whose key the
    side lacks are left out; a key without a non-null value has null statistics.
    """
    own = df.select(F.col(key).alias("_key"), F.col(row).alias("_row"), F.col(value).alias("_value"))
    plan = plan_shards(own if loads is None else loads.select(F.col(key).alias("_key")), "_key", tasks)
    other = [c for c in side.columns if c != key]
    rows = matched(own, side.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_side_{c}") for c in other]), "_key", "_row", plan)
    v, sides = F.col("_value"), [f"_side_{c}" for c in other]
    part = rows.groupBy("_task", "_key", "_shard", *sides).agg(F.count(F.lit(1)).alias("_n"), F.count(v).alias("_known"), F.sum(v).alias("_sum"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    out = part.groupBy("_key", *sides).agg(
        F.sum("_n").alias("rows"), F.try_divide(F.sum("_sum"), F.sum("_known")).alias("mean"), F.min("_lo").alias("lowest"), F.max("_hi").alias("highest")
    )
    return out.select(F.col("_key").alias(key), *[F.col(f"_side_{c}").alias(c) for c in other], "rows", "mean", "lowest", "highest")
