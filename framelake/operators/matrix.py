"""Matrices as tables (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import cut

EPS = 1e-16


def _over(df: DataFrame, side: str, total):
    """Sums by row or column joined back: partial aggregation first, no window over a hot row."""
    return df.join(df.groupBy(side).agg(total.alias("_t")), side)


def row_stochastic(m: DataFrame, eps: float = EPS) -> DataFrame:
    return _over(m, "i", F.sum("v")).select("i", "j", (F.col("v") / (F.col("_t") + eps)).alias("v"))


def column_stochastic(m: DataFrame, eps: float = EPS) -> DataFrame:
    return _over(m, "j", F.sum("v")).select("i", "j", (F.col("v") / (F.col("_t") + eps)).alias("v"))


def bistochastic(m: DataFrame, rounds: int = 10, eps: float = EPS) -> DataFrame:
    """Alternating normalization of rows and columns."""
    for k in range(rounds):
        m = column_stochastic(row_stochastic(m, eps), eps)
        if k % 3 == 2:
            m = cut(m)
    return m


def row_normalized(m: DataFrame, eps: float = EPS) -> DataFrame:
    """Rows of length one."""
    return _over(m, "i", F.sqrt(F.sum(F.col("v") * F.col("v")))).select("i", "j", (F.col("v") / (F.col("_t") + eps)).alias("v"))


def signed_root(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.signum("v") * F.sqrt(F.abs("v")))


def row_signed_root(m: DataFrame, eps: float = EPS) -> DataFrame:
    return row_normalized(signed_root(m), eps)


def arg_max(m: DataFrame) -> DataFrame:
    """(i, j, v) of the largest element; ties: smallest i, then j."""
    return m.agg(F.max_by(F.struct("i", "j", "v"), F.struct(F.col("v"), -F.col("i"), -F.col("j"))).alias("m")).select("m.*")


def arg_min(m: DataFrame) -> DataFrame:
    return m.agg(F.min_by(F.struct("i", "j", "v"), F.struct("v", "i", "j")).alias("m")).select("m.*")


def vectorize(m: DataFrame, columns: int) -> DataFrame:
    return m.select((F.col("i") * columns + F.col("j")).alias("k"), "v")


def row_softmax(m: DataFrame, temperature: float = 1.0) -> DataFrame:
    top = m.join(m.groupBy("i").agg(F.max("v").alias("_m")), "i")
    e = top.select("i", "j", F.exp((F.col("v") - F.col("_m")) / temperature).alias("v"))
    return _over(e, "i", F.sum("v")).select("i", "j", (F.col("v") / F.col("_t")).alias("v"))


def running_mean(df: DataFrame, group: list[str], order: str, value: str, n: int) -> DataFrame:
    """Mean over every n values in a row; only whole windows."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("_n", F.count(value).over(w)).where(F.col("_n") == n).drop("_n")
