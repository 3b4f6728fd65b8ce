"""Live rows: the newest delivery of every key, exact repeats once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hashable(df: DataFrame, c: Column) -> Column:
    """Maps have no hash; their sorted entries do."""
    kind = df.select(c).schema.fields[0].dataType.typeName()
    return F.array_sort(F.map_entries(c)) if kind == "map" else c


def latest(df: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """One row per non-null `key` with `columns` of the row that is last by `order`.

    A hash aggregate with map-side combine: a hot key arrives as one row per map task. Only the
    columns asked for travel. A null `order` counts as oldest; rows that tie on `order` are told
    apart by a hash of the columns, so that the result never depends on row order.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    rank = F.struct(F.col(order).isNotNull().alias("has"), F.col(order).alias("at"), F.xxhash64(*[_hashable(df, c) for c in columns.values()]).alias("tie"))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(packed, rank).alias("_row"))
        .select(key, *[F.col("_row")[n].alias(n) for n in columns])
    )
