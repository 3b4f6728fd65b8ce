import datetime as dt

from pyspark.sql import functions as F

from framelake.functions.names import load_names, resolve_column, split_of
from framelake.operators.live import latest
from framelake.operators.selection import hash_rank, smallest, smallest_per_group


def test_latest(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "old"), (1, t + dt.timedelta(1), "new"), (1, t + dt.timedelta(1), "new"), (2, None, "only"), (None, t, "x"), (3, None, "a"), (3, t, "b")]
    df = spark.createDataFrame(rows, "k long, at timestamp, v string")
    got = {(r["k"], r["v"]) for r in latest(df, "k", "at", {"v": F.col("v")}).collect()}
    assert got == {(1, "new"), (2, "only"), (3, "b")}
    assert latest(df.limit(0), "k", "at", {"v": F.col("v")}).collect() == []
    assert latest(df, "k", "at", {"m": F.create_map(F.lit("a"), F.col("v"))}).count() == 3


def test_names(spark):
    ref = spark.createDataFrame([("city bus", ["coach"], "object"), ("car", None, "object")], "category string, synonyms array<string>, kind string")
    n = load_names(ref)
    texts = ["cityBus", "CITY-BUS", " city bus ", "City_Bus", "COACH", "car\t", "cars", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n.name(n.code("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["city bus"] * 5 + ["car", None, None, None]
    one = spark.createDataFrame([(["car", None, "CAR", "x", "coach"],), (None,), ([],)], "t array<string>").select(n.codes("t").alias("c"))
    assert [r["c"] for r in one.collect()] == [[0, 1], [], []]


def test_split_names(spark):
    df = spark.createDataFrame([(" TRAIN",), ("trn",), ("Validation",), ("testing",), ("other",), (None,)], "s string").select(split_of("s").alias("x"))
    assert [r["x"] for r in df.collect()] == ["train", "train", "val", "test", None, None]


def test_hash_rank_is_dense(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.lit(1).alias("_n"))
    got = hash_rank(df, ["g"], "id", bits=4)
    for g in range(3):
        ranks = sorted(r["rank"] for r in got.where(F.col("g") == g).collect())
        assert ranks == list(range(1, len(ranks) + 1))


def test_smallest(spark):
    df = spark.range(500).select("id", ((F.col("id") * 37 % 101 + 1) / 7.0).alias("k"))
    for n in (0, 1, 13, 250, 499, 500, 900):
        want = sorted((((i * 37 % 101) + 1) / 7.0, i) for i in range(500))[:n]
        assert sorted((r["k"], r["id"]) for r in smallest(df, "k", "id", n).collect()) == want


def test_smallest_per_group(spark):
    rows = [(g, i, ((i * 37 % 101) + 1) / 7.0) for g in "abc" for i in range(300 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, id int, k double")
    limits = {"a": 133, "b": 100, "d": 5}
    got = smallest_per_group(df, "g", "k", "id", spark.createDataFrame(list(limits.items()), "g string, n int"), "n").select("g", "k", "id")
    want = [(g, k, i) for g, n in limits.items() for k, i in sorted((k, i) for h, i, k in rows if h == g)[:n]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_more_names_than_may_be_loaded(spark):
    names = [f"thing {i}" for i in range(20_500)]
    ref = spark.createDataFrame([(n, [f"syn-{i}", "shared"] if i % 2 else None) for i, n in enumerate(names)] + [(None, ["x"])], "category string, synonyms array<string>")
    df = spark.createDataFrame([("THING_7", 1), ("Syn 9", 2), ("shared", 3), ("none", 4), (None, 5)], "t string, name int")
    got = {r["name"]: r["n"] for r in resolve_column(df, "t", ref, "n").collect()}
    assert got == {1: "thing 7", 2: "thing 9", 3: max(n for i, n in enumerate(names) if i % 2), 4: None, 5: None}
    few = ref.where("category is null or category < 'thing 2'")
    loaded = load_names(few)
    same = resolve_column(df.select("t", "name", loaded.name(loaded.code("t")).alias("loaded")), "t", few, "n")
    assert all(r["n"] == r["loaded"] for r in same.collect())
