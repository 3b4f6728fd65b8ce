"""Readers of the columnar tables and their size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder of files) under `base`."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame in bytes; an upper guess where it has no statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, limit: int = 32 << 20) -> bool:
    """True if df's estimated size permits a broadcast."""
    return plan_bytes(df) <= limit
