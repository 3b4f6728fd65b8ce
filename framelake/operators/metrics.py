"""Ranking and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative_match(scores: DataFrame, probe: str, gallery: str, score: str, match: str) -> DataFrame:
    """(rank, recall): share of probes with a mate whose best mate is among the first `rank` of the gallery.

    The rank of a probe's best mate is one more than the number of better entries (ties: smaller
    gallery key first): two aggregates and a lookup, no sort of the gallery."""
    from framelake.sources.tables import small_enough

    mate = F.struct(F.col(score).alias("s"), (-F.col(gallery)).alias("g"))
    top = scores.where(F.col(match) == 1).groupBy(probe).agg(F.max(mate).alias("_m"))
    better = (F.col(score) > F.col("_m.s")) | ((F.col(score) == F.col("_m.s")) & (F.col(gallery) < -F.col("_m.g")))
    best = scores.join(F.broadcast(top) if small_enough(top) else top, probe).groupBy(probe).agg((F.count_if(better) + 1).alias("rank"))
    by_rank = best.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one row a rank
    total = by_rank.agg(F.sum("n").alias("total"))
    return by_rank.withColumn("c", F.sum("n").over(upto)).join(F.broadcast(total)).select("rank", (F.col("c") / F.col("total")).alias("recall"))


def _step(score: str, digits: int) -> Column:
    """Score on a scale of steps, by plain arithmetic, so that equal doubles always fall together."""
    return F.floor(F.col(score) * 10**digits + 0.5) / 10**digits


def roc(scores: DataFrame, score: str, truth: str, digits: int = 4) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, rounded to `digits` places so that the curve's size
    is bounded by the scale and not by the rows."""
    by = scores.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(_step(score, digits).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    t = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = by.withColumns({"cp": F.sum("p").over(down), "cn": F.sum("n").over(down)}).join(F.broadcast(t))
    return c.select("threshold", F.try_divide("cn", "all_n").alias("fpr"), F.try_divide("cp", "all_p").alias("tpr"))


def interpolate_at(curve: DataFrame, x: str, y: str, at: float) -> DataFrame:
    """One row: y at x = at, linear between the neighbouring points, constant beyond the ends."""
    lo = curve.where(F.col(x) <= at).agg(F.max_by(F.struct(x, y), F.struct(x, y)).alias("a"))
    hi = curve.where(F.col(x) >= at).agg(F.min_by(F.struct(x, y), F.struct(x, y)).alias("b"))
    j = lo.join(F.broadcast(hi))
    a, b = F.col("a"), F.col("b")
    t = F.coalesce(F.try_divide(F.lit(at) - a[x], b[x] - a[x]), F.lit(0.0))
    return j.select(F.when(a.isNull(), b[y]).when(b.isNull(), a[y]).otherwise(a[y] + (b[y] - a[y]) * t).alias(y))


def tpr_at_fpr(scores: DataFrame, score: str, truth: str, at: float = 0.01) -> DataFrame:
    return interpolate_at(roc(scores, score, truth), "fpr", "tpr", at)


def fpr_at_tpr(scores: DataFrame, score: str, truth: str, at: float = 0.85) -> DataFrame:
    return interpolate_at(roc(scores, score, truth), "tpr", "fpr", at)


def precision_recall(scores: DataFrame, score: str, truth: str, digits: int = 4) -> DataFrame:
    by = scores.where(F.col(score).isNotNull()).groupBy(_step(score, digits).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    t = by.agg(F.sum("p").alias("all_p"))
    c = by.withColumns({"cp": F.sum("p").over(down), "ck": F.sum("k").over(down)}).join(F.broadcast(t))
    return c.select("threshold", F.try_divide("cp", "ck").alias("precision"), F.try_divide("cp", "all_p").alias("recall"))


def average_precision(scores: DataFrame, group: str, score: str, truth: str, digits: int = 4) -> DataFrame:
    """Per group: sum of precision times the step of recall."""
    by = scores.where(F.col(score).isNotNull()).groupBy(group, _step(score, digits).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(group).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    c = by.withColumns({"cp": F.sum("p").over(w), "ck": F.sum("k").over(w), "all_p": F.sum("p").over(every)})
    return c.groupBy(group).agg(F.coalesce(F.sum(F.try_divide("cp", "ck") * F.try_divide("p", "all_p")), F.lit(0.0)).alias("ap"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins 1 .. bins; 0 and bins + 1 hold what lies outside."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bar(value: Column, lo: float = 0.0, hi: float = 1.0, width: int = 40) -> Column:
    """Text bar of round(width * (value - lo) / (hi - lo)) blocks."""
    n = F.rint(F.lit(width) * (F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)).cast("int")
    return F.repeat(F.lit("█"), n)
