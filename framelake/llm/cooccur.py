"""Problem 3: items that appear together."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import load_names
from framelake.operators.live import latest
from framelake.session import cut
from framelake.sources.tables import small_enough, table

#: Item that every basket holds; its stripe carries the baskets and each item's frequency.
EVERY = -1
#: Log-likelihood ratio that a pair met by chance exceeds in one case of twenty (chi-squared, one degree of freedom).
SIGNIFICANT = 3.84
#: Counts that a task holds before it hands its stripes on.
HELD = 2_000_000


def stripes(baskets: DataFrame, items: str) -> DataFrame:
    """item, stripe: map from each neighbour not smaller than the item to the baskets that hold both.

    `items` is a list of distinct non-negative ints. A basket adds the items from each of its items on
    to that item's stripe, a table of counts held by the task; whenever a task holds more than HELD
    counts, it hands its stripes on and starts anew. Then the stripes of an item are added up key by
    key. The item itself is its first neighbour (its own frequency); item -1 stands for any basket, so
    that stripe -1 holds the number of baskets and of baskets with each item.
    """
    own = F.array_sort(F.array_union(F.array(F.lit(EVERY)), F.col(items).cast("array<int>")))
    kinds = pa.schema([("item", pa.int32()), ("stripe", pa.map_(pa.int32(), pa.int64()))])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, Counter] = defaultdict(Counter)
        for b in batches:
            for s in b.column("s").to_pylist():
                for i, item in enumerate(s):
                    held[item].update(s[i:])
            if sum(map(len, held.values())) > HELD:
                yield handed(held)
                held.clear()
        if held:
            yield handed(held)

    def handed(held: dict[int, Counter]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([list(c.items()) for c in held.values()], kinds.field("stripe").type)], schema=kinds)

    def added(t: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for stripe in t.column("stripe").to_pylist():
            total.update(dict(stripe))
        return pa.table([pa.array([t.column("item")[0].as_py()], pa.int32()), pa.array([list(total.items())], kinds.field("stripe").type)], schema=kinds)

    out = "item int, stripe map<int, long>"
    own_stripes = baskets.where(F.size(items) > 0).select(own.alias("s")).mapInArrow(of_task, out)
    return own_stripes.groupBy("item").applyInArrow(added, out)


def llr(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio (G squared) of a 2x2 table."""

    def part(k: Column, row: Column, col: Column) -> Column:
        k = k.cast("double")
        return F.when(k <= 0, 0.0).otherwise(k * F.ln(k * n / (row.cast("double") * col)))

    return 2 * (part(ab, a, b) + part(a - ab, a, n - b) + part(b - ab, n - a, b) + part(n - a - b + ab, n - a, n - b))


def associations(baskets: DataFrame, items: str) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, n, lift, llr of every pair that occurs together.

    lift = n_ab * n / (n_a * n_b); llr is signed: negative where the pair is rarer than chance.
    Null or empty lists count as no basket; repeats in a list must be removed before (array_distinct).
    """
    pairs = cut(stripes(baskets, items).select("item", F.explode("stripe").alias("near", "n")))
    every = pairs.where(F.col("item") == EVERY).select(F.col("near").alias("x"), F.col("n").alias("k"))
    total = every.where(F.col("x") == EVERY).first()
    n = F.lit(total["k"] if total else 0).cast("long")
    side = lambda c, k: (F.broadcast(every) if small_enough(every) else every).select(F.col("x").alias(c), F.col("k").alias(k))
    out = pairs.where((F.col("item") != EVERY) & (F.col("item") < F.col("near"))).select(F.col("item").alias("a"), F.col("near").alias("b"), F.col("n").alias("n_ab"))
    out = out.join(side("a", "n_a"), "a").join(side("b", "n_b"), "b").withColumn("n", n)
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    score = llr(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"))
    return out.withColumn("lift", lift).withColumn("llr", F.when(F.col("lift") >= 1, score).otherwise(-score))


def image_items(spark: SparkSession, d: str, names) -> DataFrame:
    """image_id, items: codes of the names among a live image's tags and its live detections' categories."""
    image = latest(table(spark, d, "image"), "image_id", "ingested_at", {"codes": names.codes("tags")})
    marked = image.select("image_id", F.explode(F.array_union(F.array(F.lit(EVERY)), "codes")).alias("code"))
    det = latest(table(spark, d, "detection"), "detection_id", "ingested_at", {"image_id": F.col("image_id"), "code": names.code("category")})
    det = det.where("image_id is not null and code is not null").select("image_id", "code")
    sets = marked.unionByName(det).groupBy("image_id").agg(F.collect_set("code").alias("s")).where(F.array_contains("s", EVERY))
    return sets.select("image_id", F.array_remove("s", EVERY).alias("items"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with their counts, lift and log-likelihood ratio."""
    names = load_names(table(spark, d, "category_ref"))
    out = associations(image_items(spark, d, names), "items")
    return out.select(names.name("a").alias("item_a"), names.name("b").alias("item_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def significant(pairs: DataFrame, least: int, lift: int, llr: float = SIGNIFICANT) -> DataFrame:
    """Of associations(), pairs met in `least` baskets or more, `lift` times as often as by chance or
    more, with a log-likelihood ratio of at least llr.

    For 5 baskets and a lift of 3 the ratio is at least 2 * (5 ln 3 - (5 - 5 / 3)) = 4.3, so that every
    such pair is significant at this level."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where((F.col("llr") >= llr) & (F.col("n_ab") >= least) & (big("n_ab") * big("n") >= lift * big("n_a") * big("n_b")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = load_names(table(spark, d, "category_ref"))
    out = significant(associations(image_items(spark, d, names), "items"), 5, 3)
    return out.select(names.name("a").alias("item_a"), names.name("b").alias("item_b"))
