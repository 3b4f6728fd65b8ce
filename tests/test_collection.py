from pyspark.sql import functions as F

from framelake.operators.collection import POS, Collection


def values(c):
    return [r["value"] for r in c.dense().df.orderBy(POS).collect()]


def test_golden(spark):
    a, b = Collection.from_list(spark, ["d", "c"]), Collection.from_list(spark, ["a", "a"])
    u = a | b
    assert values(u) == ["d", "a", "c", "a"]
    assert values(u.repeat(2)) == ["d", "d", "a", "a", "c", "c", "a", "a"]
    assert values(u | u) == ["d", "d", "a", "a", "c", "c", "a", "a"]
    assert values(u.sort("value")) == ["a", "a", "c", "d"]
    assert values(u.filter(F.col("value") != "a")) == ["d", "c"]
    assert [(r["key"], r["n"]) for r in u.frequency("value").collect()] == [("c", 1), ("d", 1), ("a", 2)]
    assert u.count(F.col("value") == "a").first()["n"] == 2
    assert not u.balanced("value").first()["balanced"]
    assert values(u.slice()) == ["d", "a", "c"]
    assert values(u.shift(1)) == ["a", "c", "a", "d"]
    assert values(u.at([-1, 0])) == ["a", "d"]
    assert values(Collection.cast(spark, "x")) == ["x"]


def test_uneven_union_and_zip(spark):
    a, b = Collection.from_list(spark, list("abcd")), Collection.from_list(spark, list("xy"))
    assert values(a | b) == ["a", "x", "b", "y", "c", "d"]
    assert [(r["value"], r["value_2"]) for r in a.zip(b).df.orderBy(POS).collect()] == [("a", "x"), ("b", "y")]


def test_batches_and_windows(spark):
    c = Collection.from_list(spark, list(range(10)), schema="value int")
    assert [r["n"] for r in c.batch(4).df.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [4, 4]
    assert c.batch(4, ragged=True).df.groupBy("batch").count().count() == 3
    assert [r["items"] for r in c.overlapping("value", 4, 2).orderBy("window").collect()] == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9]]
    p = [(r["first"], r["second"]) for r in c.truncate(3).pairwise("value", True, True).orderBy("place").collect()]
    assert p == [(None, 0), (0, 1), (1, 2), (2, None)]
    steps = [(r["head"], r["tail"]) for r in c.pipeline(5, 2, "value").orderBy("step").collect()]
    assert steps == [([0, 1, 2, 3, 4], None), ([5, 6, 7, 8, 9], [0, 1, 2, 3, 4]), (None, [5, 6, 7, 8, 9])]
    s = c.partition(0.7, 0.1, 0.2).df.groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 7, "val": 1, "test": 2}


def test_same_in_every_layout(spark):
    df = spark.range(200).select("id")
    a = Collection.of(df.repartition(3), ["id"]).shuffle("id", 5)
    b = Collection.of(df.repartition(7), ["id"]).shuffle("id", 5)
    assert [r["id"] for r in a.list().collect()] == [r["id"] for r in b.list().collect()]
    assert Collection.of(df.limit(0), ["id"]).balanced("id").first()["balanced"] is False


def test_failures(spark):
    c = Collection.from_list(spark, [1, 0, 2], schema="value int")
    got = c.try_map(lambda r: (10 // r["value"],), "q long")
    assert [r["q"] for r in got.list().collect()] == [10, 5]
