"""Streams of frames and events: time windows, windows by count, delays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.session import shared_folder


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A parquet file or folder as a stream, a file (by age) a batch."""
    import os

    folder, pattern = os.path.split(path) if path.endswith(".parquet") and not os.path.isdir(path) else (path, "*.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(folder)


def replay_in_order(df: DataFrame, ts: str, parts: int = 5, late: Column | None = None, end: dict[str, object] | None = None) -> DataFrame:
    """A table as a stream of `parts` batches by equal spans of event time, written one after the other
    into a folder beside the checkpoints.

    late: rows that come three batches after their time (rows count as late by the watermark of the batch before the last). end: values of a row 60 days after the last
    one, with which all windows before it close; its own stay open."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "replay")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    if lo is None:
        lo = hi = 0
    span = max(1, -(-(hi - lo + 1) // parts))
    part = F.floor((us - lo) / span)
    if late is not None:
        part = F.least(F.when(late, part + 3).otherwise(part), F.lit(parts - 1))
    kind = df.schema[ts].dataType.simpleString()
    for i in range(parts):
        rows = df.where(part == i)
        if i == parts - 1 and end is not None:
            at = F.timestamp_micros(F.lit(hi + 60 * 86_400_000_000)).cast(kind)
            rows = rows.unionByName(spark.range(1).select(*[(at if f.name == ts else F.lit(end.get(f.name)).cast(f.dataType)).alias(f.name) for f in df.schema.fields]))
        rows.coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return replay(spark, folder, df.schema)


def event_time(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], aggs: list) -> DataFrame:
    g = df.groupBy(F.window(ts, size).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), *by, *[c for c in g.columns if c not in ("w", *by)])


def sliding(df: DataFrame, ts: str, size: str, step: str, by: list[str], aggs: list) -> DataFrame:
    g = df.groupBy(F.window(ts, size, step).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), *by, *[c for c in g.columns if c not in ("w", *by)])


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggs: list) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in g.columns if c not in ("w", *by)])


#: Time without rows after which the state of a key is given up.
KEEP = "90 days"


def _stateful(df: DataFrame, key: str, kind: str, order: str, value: str, out: str, step: Callable[[list, list], tuple[list, list]], keep: str = KEEP) -> DataFrame:
    """Rows of each key in order through `step(buffer, new) -> (rows out, buffer)`; the buffer is state.

    Rows that come in a later batch than rows behind them in order are late and left out. df has a
    watermark: a key without rows for `keep` of event time loses its state."""
    names = [c.strip().split()[0] for c in out.split(",")]
    milliseconds = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, orders, values = state.get if state.exists else (0, None, [], [])
        new = pd.concat(list(frames)).sort_values(order)
        if last is not None:
            new = new[new[order] > last]
        rows, (n, buffer) = step((n, list(zip(orders, values))), list(zip(new[order].tolist(), new[value].tolist())))
        last = int(new[order].iloc[-1]) if len(new) else last
        state.update((n, last, [int(b[0]) for b in buffer], [float(b[1]) for b in buffer]))
        state.setTimeoutTimestamp(max(1, state.getCurrentWatermarkMs()) + milliseconds)
        if rows:
            yield pd.DataFrame([(k[0], *r) for r in rows], columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "n bigint, last bigint, o array<bigint>, v array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def count_windows(df: DataFrame, key: str, kind: str, order: str, value: str, n: int, m: int, delay: int = 0) -> DataFrame:
    """Sliding windows by count: the last n values each time m new ones have come (and n in all), the
    first `delay` values left out.

    State a key: the last n - 1 values. Columns: key, startplace, endplace (places of the window's first
    and last item), at (order of its last item), total, size."""

    def step(state, new):
        seen, buffer = state
        rows = []
        for item in new:
            seen += 1
            if seen <= delay:
                continue
            buffer = [*buffer, item][-n:]
            had = seen - delay
            if had >= max(n, m) and (had - max(n, m)) % m == 0:
                rows.append((seen - len(buffer), seen - 1, int(item[0]), float(sum(v for _, v in buffer)), len(buffer)))
        return rows, (seen, buffer)

    return _stateful(df, key, kind, order, value, "startplace bigint, endplace bigint, at bigint, total double, size bigint", step)


def delayed(df: DataFrame, key: str, kind: str, order: str, value: str, delay: int) -> DataFrame:
    """Each item beside the value `delay` items before; the first `delay` items give none."""

    def step(state, new):
        seen, buffer = state
        rows = []
        for item in new:
            buffer = [*buffer, item][-(delay + 1) :]
            if len(buffer) > delay:
                rows.append((int(item[0]), float(buffer[0][1])))
            seen += 1
        return rows, (seen, buffer)

    return _stateful(df, key, kind, order, value, "at bigint, value double", step)


def distinct_by_window(df: DataFrame, ts: str, size: str, of: str) -> DataFrame:
    """start, n: distinct values of `of` by window, exact: one state row a window and value, counted by a second aggregate."""
    one = df.groupBy(F.window(ts, size).alias("w"), of).agg(F.count(F.lit(1)).alias("k"))
    g = one.groupBy(F.window(F.window_time("w"), size).alias("v")).agg(F.count(of).alias("n"))
    return g.select(F.col("v.start").alias("start"), "n")


def run_to_files(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now into parquet files beside the checkpoints, and reads them."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, f"stream-{name}")
    q = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
