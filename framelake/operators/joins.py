"""Joins by place and time that Catalyst would otherwise run as nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import box as B


def _cells(b: Column, cell: float) -> Column:
    """Numbers of the grid cells that a box touches, as struct(cx, cy)."""
    x = F.sequence(F.floor(b["xmin"] / cell), F.floor(b["xmax"] / cell))
    y = F.sequence(F.floor(b["ymin"] / cell), F.floor(b["ymax"] / cell))
    return F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, left_box: str = "box", right_box: str = "box", prefix: tuple[str, str] = ("a_", "b_"), only: Column | None = None) -> DataFrame:
    """Pairs of overlapping boxes with equal keys; columns get the prefixes, keys keep their names.

    Both sides are sent to the grid cells they touch and joined on (keys, cell), an equi-join that
    spreads a crowded image over many tasks. A pair met in several cells is kept in the one that
    holds the upper left corner of its intersection, so no distinct is needed. `cell` should be
    about the size of a usual box. Invalid boxes meet nothing.
    """

    def side(df: DataFrame, b: str, p: str) -> DataFrame:
        cols = [F.col(c) if c in keys else F.col(c).alias(p + c) for c in df.columns]
        return df.where(B.valid(F.col(b))).select(*cols, F.explode(_cells(F.col(b), cell)).alias("cell"))

    a, b = side(left, left_box, prefix[0]), side(right, right_box, prefix[1])
    x, y = F.col(prefix[0] + left_box), F.col(prefix[1] + right_box)
    owner = (F.col("cell.cx") == F.floor(F.greatest(x["xmin"], y["xmin"]) / cell)) & (F.col("cell.cy") == F.floor(F.greatest(x["ymin"], y["ymin"]) / cell))
    cond = owner & B.overlaps(x, y)
    out = a.join(b, [*keys, "cell"]).where(cond if only is None else cond & only)
    return out.drop("cell")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: int, closed: bool = True) -> DataFrame:
    """Pairs of rows with equal keys whose spans overlap; clashing columns of right get the suffix _2.

    Spans are sent to the time buckets they touch and joined on (keys, bucket); a pair is kept in the
    bucket of the later start. closed: spans that touch in one point overlap.
    """
    (ls, le), (rs, re) = left_span, right_span
    names = {c: c if c in keys or c not in left.columns else c + "_2" for c in right.columns}
    a = left.where(F.col(le) >= F.col(ls)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(ls) / bucket), F.floor(F.col(le) / bucket))))
    b = right.where(F.col(re) >= F.col(rs)).select(*[F.col(c).alias(n) for c, n in names.items()])
    rs, re = names[rs], names[re]
    b = b.withColumn("_b", F.explode(F.sequence(F.floor(F.col(rs) / bucket), F.floor(F.col(re) / bucket))))
    later = F.greatest(F.col(ls), F.col(rs))
    meets = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if closed else F.least(F.col(le), F.col(re)) > later
    return a.join(b, [*keys, "_b"]).where(meets & (F.floor(later / bucket) == F.col("_b"))).drop("_b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, of: str, take: list[str]) -> DataFrame:
    """As-of join to the nearest: for each left row the `take` columns of the right row with the
    smallest |of - at| (ties: the smaller `of`), or nulls.

    One union and two window passes over (keys, time) instead of a join: linear in the rows of a key.
    """
    from pyspark.sql import Window

    cols = [c for c in left.columns if c not in keys]
    l_rows = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).alias("_r"))
    packed = F.struct(F.col(of).alias("_of"), *[F.col(c) for c in take])
    r_rows = right.select(*keys, F.col(of).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    u = l_rows.drop("_r").unionByName(r_rows, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_p", F.last("_r", ignorenulls=True).over(back)).withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)).where("_side = 1")
    closer = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p"))
    closer = closer.when(F.col("_t") - F.col("_p._of") <= F.col("_n._of") - F.col("_t"), F.col("_p")).otherwise(F.col("_n"))
    u = u.withColumn("_c", closer)
    return u.select(*keys, *[F.col(f"_l.{c}") for c in cols], *[F.col(f"_c.{c}").alias(c if c not in left.columns else c + "_2") for c in take])


def block_join(queries: DataFrame, rows: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Every row of a stated query set beside every row of `rows`, in blocks.

    Queries are dealt to blocks of about block_rows; `rows` pass each block once, by an equi-join on
    the block number, so that no side has to fit anywhere as a whole."""
    n = max(1, -(-queries.count() // block_rows))
    a = queries.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c, k in queries.dtypes if not k.startswith(("map", "variant"))]), F.lit(n)))
    b = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    if n == 1:  # one block: salted, so that its rows are spread over tasks
        salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a = a.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        b = b.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        return a.join(b, ["_b", "_s"]).drop("_b", "_s")
    return a.join(b, "_b").drop("_b")


def with_dimension(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left", limit: int = 32 << 20) -> DataFrame:
    """Lookup join: broadcast where the dimension's size estimate permits, else by shuffle."""
    from framelake.sources.tables import small_enough

    return facts.join(F.broadcast(dim) if small_enough(dim, limit) else dim, on, how)
