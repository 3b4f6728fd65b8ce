"""Ordered collections: a frame with a position column, and the algebra of ordered items.

Every method returns a new collection. Filters, maps and choices by place are lazy; what gives rows
new places (of, sort, shuffles, union, flatten, dense) writes them once to the checkpoint folder, as
numbering and counting must see the same partitions. Positions are dense, 0 .. N-1, and made without
sending all rows to one task: rows are range-partitioned and sorted, numbered within partitions, and
shifted by the sizes of the partitions before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators.selection import smallest
from framelake.session import cut

POS = "_pos"


def with_positions(df: DataFrame, order: Sequence[str | Column], pos: str = POS) -> DataFrame:
    """Adds dense positions in the given total order. One range shuffle; the sorted rows are cut so
    that numbering and counting see the same partitions."""
    keep = [c for c in df.columns if c != pos]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    df = df.select(*[c for c in df.columns if c != pos], *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.select(*keep, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(shift), "_p").select(*keep, (F.col("_s") + F.col("_i")).alias(pos))


def col(f: Column | str) -> Column:
    return F.col(f) if isinstance(f, str) else f


def _hash_number(key: Column, seed: int, digits: int) -> Column:
    """The first hexadecimal digits of a hash as a number."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, digits), 16, 10)
    return n.cast("double" if digits <= 12 else "bigint")


class Collection:
    """An ordered collection of rows."""

    def __init__(self, df: DataFrame, name: str = "", dense: bool = True):
        self.df, self.name, self._dense = df, name, dense

    # construction ------------------------------------------------------------------------------
    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Column], name: str = "") -> "Collection":
        return cls(with_positions(df, order), name)

    @classmethod
    def from_list(cls, spark: SparkSession, items: Sequence, name: str = "", schema: str = "value string") -> "Collection":
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]
        return cls(spark.createDataFrame(rows, f"{POS} long, {schema}"), name)

    @classmethod
    def cast(cls, spark: SparkSession, obj, schema: str = "value string") -> "Collection":
        """Lists, tuples and sets are items, a dict its pairs, a collection itself, anything else one item."""
        if isinstance(obj, Collection):
            return obj
        if isinstance(obj, DataFrame):
            return cls.of(obj, [F.monotonically_increasing_id()])
        if isinstance(obj, dict):
            return cls.from_list(spark, list(obj.items()), schema="key string, value string")
        if isinstance(obj, (list, tuple, set, frozenset)):
            return cls.from_list(spark, list(obj), schema=schema)
        return cls.from_list(spark, [obj], schema=schema)

    def dense(self) -> "Collection":
        """Positions 0 .. N-1 again after rows were left out."""
        return self if self._dense else Collection(with_positions(self.df, [POS]), self.name)

    def _sub(self, df: DataFrame, dense: bool = False, name: str | None = None) -> "Collection":
        return Collection(df, self.name if name is None else name, dense)

    # rows and values ---------------------------------------------------------------------------
    def filter(self, f: Column) -> "Collection":
        return self._sub(self.df.where(f))

    def map(self, *cols: Column | str) -> "Collection":
        return self._sub(self.df.select(POS, *cols), self._dense)

    def try_map(self, f: Callable, out: str, strict: bool = False) -> "Collection":
        """Python function of a pandas frame per Arrow batch, row by row; failures raise, or with
        strict=False leave their rows out. `out` is the DDL of the result; f takes a row's dict."""
        import pandas as pd

        names = [c.strip().split()[0] for c in out.split(",")]

        def run(frames):
            for pdf in frames:
                rows = []
                for r in pdf.to_dict("records"):
                    try:
                        rows.append((r[POS], *(f(r))))
                    except Exception:
                        if strict:
                            raise
                yield pd.DataFrame(rows, columns=[POS, *names])

        return self._sub(self.df.mapInPandas(run, f"{POS} long, {out}"), self._dense and strict)

    def flatten(self, array: str, out: str) -> "Collection":
        e = self.df.select("*", F.posexplode(array).alias("_k", out))
        return Collection.of(e.drop(array if array != out else "_none"), [POS, "_k"], self.name)._drop("_k")

    def _drop(self, *cols: str) -> "Collection":
        return self._sub(self.df.drop(*cols), self._dense)

    def set(self, f: Column | str) -> DataFrame:
        return self.df.select(col(f).alias("value")).distinct()

    def list(self) -> DataFrame:
        return self.df.orderBy(POS)

    def count(self, f: Column | None = None) -> DataFrame:
        """One row: items for which f is true (all items without f)."""
        return self.df.agg((F.count(F.lit(1)) if f is None else F.count_if(F.coalesce(f, F.lit(False)))).alias("n"))

    def all(self, f: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(f), F.lit(True)).alias("value"))

    # grouping ----------------------------------------------------------------------------------
    def frequency(self, f: Column | str) -> DataFrame:
        """Counts by key, in ascending order of count, then key."""
        return self.df.groupBy(col(f).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "key")

    def inverse_frequency(self, f: Column | str) -> DataFrame:
        """(N / n_k) / K by key."""
        n = self.df.groupBy(col(f).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("keys"))
        return n.join(F.broadcast(total)).select("key", (F.col("total") / F.col("n") / F.col("keys")).alias("weight"))

    def balanced(self, f: Column | str) -> DataFrame:
        """One row: whether all keys are equally frequent; false for an empty collection."""
        n = self.df.groupBy(col(f).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(((F.min("n") == F.max("n")) & (F.count(F.lit(1)) > 0)).alias("v")).select(F.coalesce("v", F.lit(False)).alias("balanced"))

    def sumby(self, key: Column | str, value: Column | str) -> DataFrame:
        return self.df.groupBy(col(key).alias("key")).agg(F.sum(col(value)).alias("total"))

    def groupby(self, key: Column | str, value: Column | str) -> DataFrame:
        """Values by key in the order of the collection. Use only where a group fits a task; other
        results by key are aggregates."""
        packed = F.array_sort(F.collect_list(F.struct(F.col(POS), col(value).alias("v"))))
        return self.df.groupBy(col(key).alias("key")).agg(packed.alias("p")).select("key", F.col("p.v").alias("values"))

    def most_frequent(self, key: Column | str, k: int | None = 1) -> DataFrame:
        """The k most frequent keys, the most frequent last."""
        n = self.df.groupBy(col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("key"))
        return (n if k is None else n.limit(k)).orderBy("n", "key")

    def dedupe(self, key: Column | str, *values: str) -> "Collection":
        """One item per key: the last one's values at the first one's place."""
        aggs = [F.max_by(F.col(v), F.col(POS)).alias(v) for v in values]
        return self._sub(self.df.groupBy(col(key).alias("key")).agg(F.min(POS).alias(POS), *aggs))

    # order -------------------------------------------------------------------------------------
    def sort(self, f: Column | str) -> "Collection":
        """Stable."""
        return Collection.of(self.df.withColumnRenamed(POS, "_was"), [col(f), F.col("_was")], self.name)._drop("_was")

    def shuffle(self, key: str, seed: int = 0) -> "Collection":
        """A uniform permutation, the same in every run: order of a hash of the unique key."""
        return Collection.of(self.df.drop(POS), [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], self.name)

    def chunk_shuffle(self, key: str, size: int, seed: int = 0) -> "Collection":
        """Chunks of `size` neighbours in random order, and random order within each: keeps locality."""
        d = self.dense()
        c = F.floor(F.col(POS) / size)
        h = lambda x: F.md5(F.concat(F.lit(f"{seed}:"), x.cast("string")))
        return Collection.of(d.df.withColumn("_c", h(c)).drop(POS), [F.col("_c"), h(F.col(key)), F.col(key)], self.name)._drop("_c")

    def streaming_shuffle(self, seed: int = 0) -> DataFrame:
        """Approximate: rows spread at random, random order within partitions; no global sort."""
        return self.df.repartition(F.rand(seed)).sortWithinPartitions(F.rand(seed + 1))

    def size(self) -> int:
        return self.df.count()

    # positions ---------------------------------------------------------------------------------
    def at(self, places: Sequence[int]) -> "Collection":
        """Items at the given places, in the order given, repeats allowed; negative places from the end."""
        d, n = self.dense(), None
        if any(p < 0 for p in places):
            n = d.size()
        want = [(i, p if p >= 0 else p + n) for i, p in enumerate(places)]
        t = self.df.sparkSession.createDataFrame(want, "_to long, _at long")
        out = d.df.join(F.broadcast(t), F.col(POS) == F.col("_at")).drop(POS, "_at").withColumnRenamed("_to", POS)
        return self._sub(out)

    def slice(self, start: int = 0, stop: int = -1, step: int = 1) -> "Collection":
        """Places start, start + step, ... before stop; the default stop leaves out the last item."""
        d = self.dense()
        if start < 0 or stop < 0:
            n = d.size()
            start, stop = (x + n if x < 0 else x for x in (start, stop))
        keep = (F.col(POS) >= start) & (F.col(POS) < stop) & (F.pmod(F.col(POS) - start, F.lit(step)) == 0)
        return Collection(d.df.where(keep).withColumn(POS, F.floor((F.col(POS) - start) / step)), self.name)

    def truncate(self, m: int) -> "Collection":
        return self.slice(0, m) if m >= 0 else self.slice(0, m)

    def shift(self, m: int) -> "Collection":
        """Circular, to the left."""
        d = self.dense()
        n = max(1, d.size())
        return Collection(d.df.withColumn(POS, F.pmod(F.col(POS) - m, F.lit(n))), self.name)

    def repeat(self, n: int) -> "Collection":
        """Each item n times in a row."""
        d = self.dense()
        if n <= 0:
            return Collection(d.df.limit(0), self.name)
        e = d.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return Collection(e.withColumn(POS, F.col(POS) * n + F.col("_k")).drop("_k"), self.name)

    def zip(self, other: "Collection") -> "Collection":
        """Items side by side by place; the shorter one ends it. Clashing columns of other get the suffix _2."""
        a, b = self.dense().df, other.dense().df
        b = b.select(POS, *[F.col(c).alias(c + "_2" if c in a.columns else c) for c in b.columns if c != POS])
        return Collection(a.join(b, POS), self.name)

    def union(self, *others: "Collection", interleave: bool = True) -> "Collection":
        """Bag union, taking one item from each in turn; exhausted ones are passed over."""
        parts = [c.dense().df.withColumn("_d", F.lit(i)) for i, c in enumerate((self, *others))]
        u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        order = [F.col("_was"), F.col("_d")] if interleave else [F.col("_d"), F.col("_was")]
        return Collection.of(u.withColumnRenamed(POS, "_was"), order, self.name)._drop("_was", "_d")

    __or__ = union

    # chunks and windows ------------------------------------------------------------------------
    def chunk(self, n: int) -> "Collection":
        """n consecutive chunks of ceil(N / n) items, the last ones shorter: adds `chunk`."""
        d = self.dense()
        size = max(1, math.ceil(d.size() / n))
        return Collection(d.df.withColumn("chunk", F.floor(F.col(POS) / size)), self.name)

    def batch(self, n: int, ragged: bool = False) -> "Collection":
        """Batches of n items, adds `batch`; a shorter last one is left out unless ragged."""
        d = self.dense()
        out = d.df.withColumn("batch", F.floor(F.col(POS) / n))
        if not ragged:
            out = out.where(F.col("batch") < d.size() // n)
        return Collection(out, self.name)

    def minibatch(self, n: int, accept: Column | None = None, ragged: bool = True) -> "Collection":
        """Items that are accepted, in batches numbered after the others are left out."""
        return (self if accept is None else self.filter(accept)).batch(n, ragged)

    def pipeline(self, n: int, m: int, value: str, ragged: bool = True, prepad: bool = True, postpad: bool = True) -> DataFrame:
        """(step, head, tail): batches of n and those m - 1 batches before them, with nulls as padding."""
        b = self.batch(n, ragged).df.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(POS, value))).alias("p"))
        b = b.select("batch", F.col(f"p.{value}").alias("items"))
        lag = max(0, m - 1)
        head, tail = b.select(F.col("batch").alias("step"), F.col("items").alias("head")), b.select((F.col("batch") + lag).alias("step"), F.col("items").alias("tail"))
        out = head.join(tail, "step", "full_outer")
        if not prepad:
            out = out.where("step >= %d" % lag)
        if not postpad:
            out = out.where("head is not null")
        return out

    def pairwise(self, value: str, prepad: bool = False, postpad: bool = False) -> DataFrame:
        """(place, first, second) of neighbours; padding gives pairs with a null. By join on places."""
        d = self.dense().df.select(POS, value)
        a = d.select((F.col(POS) + 1).alias("place"), F.col(value).alias("first"))
        b = d.select(F.col(POS).alias("place"), F.col(value).alias("second"))
        out = a.join(b, "place", "full_outer")
        if not prepad:
            out = out.where("place > 0")
        if not postpad:
            n = self.size()
            out = out.where(F.col("place") < n)
        return out

    def overlapping(self, value: str, size: int, overlap: int) -> DataFrame:
        """(window, items): windows of `size` items, each sharing `overlap` with the one before; whole ones only.

        Every item is sent to the few windows it lies in; windows are put together in parallel."""
        d = self.dense()
        n, stride = d.size(), size - overlap
        last = (n - size) // stride if n >= size else -1
        lo = F.greatest(F.ceil((F.col(POS) - size + 1) / stride), F.lit(0))
        hi = F.least(F.floor(F.col(POS) / stride), F.lit(last))
        e = d.df.where(hi >= lo).select(POS, value, F.explode(F.sequence(lo, hi)).alias("window"))
        return e.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(POS, value))).alias("p")).select("window", F.col(f"p.{value}").alias("items"))

    # partitions and samples --------------------------------------------------------------------
    def chunks(self, sizes: Sequence[int]) -> "Collection":
        """Consecutive parts of the given sizes: adds `part`; items beyond the last are left out."""
        d, upto, part = self.dense(), 0, F.lit(None).cast("int")
        for i, s in enumerate(sizes):
            part = F.when((F.col(POS) >= upto) & (F.col(POS) < upto + s), i).otherwise(part)
            upto += s
        return Collection(d.df.withColumn("part", part).where("part is not null"), self.name)

    def split(self, size: int) -> "Collection":
        return self.chunks([size, max(0, self.size() - size)])

    def even_split(self) -> "Collection":
        """Two halves; an odd last item is left out."""
        n = self.size() // 2
        return self.chunks([n, n])

    def partition(self, train: float = 0.9, val: float = 0.1, test: float = 0.0) -> "Collection":
        """Adds `split`: from the front ceil(N * test) test items, ceil(N * val) val items, then train."""
        if abs(train + val + test - 1) > 1e-6:
            raise ValueError("fractions must sum to one")
        n = self.size()
        t = math.ceil(n * test - 1e-9)
        v = math.ceil(n * val - 1e-9)
        s = F.when(F.col(POS) < t, "test").when(F.col(POS) < t + v, "val").otherwise("train")
        return Collection(self.dense().df.withColumn("split", s), self.name)

    def take(self, n: int, key: str, seed: int = 0) -> "Collection":
        """n random items, the same in every run; with replacement if n exceeds the items there are."""
        size = self.size()
        if n <= size:
            # By the first 48 bits of the hash, without a global sort or one task for all that is taken.
            return self._sub(smallest(self.df.withColumn("_h", _hash_number(F.col(key), seed, 12) + 1), "_h", key, n).drop("_h"))
        draws = self.df.sparkSession.range(n).select(F.col("id").alias("_to"), F.pmod(_hash_number(F.col("id"), seed, 15).cast("bigint"), F.lit(max(1, size))).alias("_at"))
        d = self.dense().df
        return self._sub(draws.join(d, F.col("_at") == F.col(POS)).drop("_at", POS).withColumnRenamed("_to", POS))

    def take_fraction(self, p: float, key: str, seed: int = 0) -> "Collection":
        return self.take(int(self.size() * p), key, seed)

    def take_by(self, group: Column | str, n: int, key: str, seed: int = 0) -> "Collection":
        """n random items of each group."""
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
        r = self.df.withColumn("_g", col(group)).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(h, key)))
        return self._sub(r.where(F.col("_r") <= n).drop("_g", "_r"))

    def last(self) -> DataFrame:
        return self.df.orderBy(F.desc(POS)).limit(1)

    def cache(self) -> "Collection":
        from pyspark import StorageLevel

        return self._sub(self.df.persist(StorageLevel.MEMORY_AND_DISK), self._dense)

    def iterate(self):
        """Rows one by one, a partition at a time on the driver."""
        return self.df.orderBy(POS).toLocalIterator(prefetchPartitions=True)
