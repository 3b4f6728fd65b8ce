"""Problem 4: a sample that reruns, layouts and growth do not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import instance_key
from framelake.operators.live import latest
from framelake.sources.tables import table

#: 2**31 / golden ratio, made odd; steps by it fill the circle of 2**31 points most evenly.
STEP, CIRCLE = 1327217885, 1 << 31


def golden_point(stream: Column, number: Column, seed: str) -> Column:
    """Point on the circle 0 .. 2**31 - 1: number times the golden step, plus the stream's fixed shift.

    The shift is taken from the MD5 of seed and stream name: random, but the same in every run.
    """
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), stream)), 1, 7), 16, 10).cast("long")
    return F.pmod(F.pmod(number, F.lit(CIRCLE)) * F.lit(STEP) + shift * F.lit(8), F.lit(CIRCLE))


def golden_sample(df: DataFrame, stream: str, number: str, rate: float, seed: str = "golden") -> DataFrame:
    """Rows of df whose (stream, number) lies in the kept interval of length `rate` of the circle.

    A row's membership depends on its own key, rate and seed only: it is the same in every run and
    layout, stays when rows are added, and a larger rate keeps all members of a smaller one. Of any
    run of consecutive numbers a nearly equal share is kept. Every row of a kept key is kept. Rows
    whose stream or number is null are never kept. rate <= 0 keeps none, rate >= 1 all with a key.
    One narrow pass: no shuffle, no state.
    """
    kept = golden_point(F.col(stream), F.col(number).cast("long"), seed) < F.lit(int(max(0.0, min(1.0, rate)) * CIRCLE))
    return df.where(F.col(stream).isNotNull() & F.col(number).isNotNull() & kept)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """Live images of a tenth of the instances: image_id, source, number, release_no."""
    cols = {"key": instance_key("instanceid"), "release_no": F.col("release_no")}
    live = latest(table(spark, d, "image"), "image_id", "ingested_at", cols)
    keyed = live.where("key is not null").select("image_id", F.col("key.source").alias("source"), F.col("key.number").alias("number"), "release_no")
    return golden_sample(keyed, "source", "number", 0.1)


ORACLE = """with li as (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image),
k as (select image_id, release_no, regexp_extract(lower(instanceid), '^\\s*([a-z][a-z0-9_.-]*?)\\s*[:/#|]\\s*(?:[a-z]+\\s*[:/#|]\\s*)?([0-9]{1,18})\\s*$', 1) as source,
 try_cast(regexp_extract(lower(instanceid), '^\\s*([a-z][a-z0-9_.-]*?)\\s*[:/#|]\\s*(?:[a-z]+\\s*[:/#|]\\s*)?([0-9]{1,18})\\s*$', 2) as bigint) as number from li where rn = 1)
select image_id, source, number, release_no from k where number is not null
and ((number % 2147483648) * 1327217885 + cast('0x' || substr(md5('golden:' || source), 1, 7) as bigint) * 8) % 2147483648 < 214748364"""
