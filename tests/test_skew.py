import random
from collections import defaultdict

from framelake.operators.skew import matched, plan_shards, profile_per_key, replicate, top_per_key


def data(n=3000):
    rnd = random.Random(2)
    keys = ["hot"] * 6 + ["b", "c", None, "d"]
    return [(rnd.choice(keys), i, rnd.choice([None, float("nan"), rnd.randrange(20) / 10]), "x") for i in range(n)]


def test_top_per_key(spark):
    rows = data()
    rows += rows[:50]  # repeats
    df = spark.createDataFrame(rows, "k string, id long, v double, _key string")
    side = spark.createDataFrame([(k, k.upper()) for k in ("hot", "b", "c", "none")], "k string, v string")  # a clashing name
    got = [tuple(r) for r in top_per_key(df, "k", "v", "id", 3, side.withColumnRenamed("v", "label"), 5).collect()]
    assert len(got) == len(set(got)) and sorted(tuple(r) for r in top_per_key(df, "k", "v", "id", 3, side, 5).collect()) == sorted(got)
    by = defaultdict(set)
    for k, i, v, _ in rows:
        if k in ("hot", "b", "c") and v is not None and v == v:
            by[k].add((-v, i))
    assert set(got) == {(k, k.upper(), i, -v) for k, s in by.items() for v, i in sorted(s)[:3]}


def test_plan_is_level(spark):
    df = spark.createDataFrame(data(), "k string, id long, v double, x string")
    plan = plan_shards(df, "k", 6)
    assert len(plan.places["hot"]) >= 4
    assert max(plan.loads) < 1.6 * sum(plan.loads) / 6
    assert len({t for t in plan.places["hot"]}) >= 3


def test_profile_per_key(spark):
    rows = data()
    df = spark.createDataFrame(rows, "k string, id long, v double, x string").where("not isnan(v) or v is null")
    side = spark.createDataFrame([("hot", "H"), ("b", "B"), ("none", "N")], "k string, label string")
    got = {r["k"]: r for r in profile_per_key(df, "k", "id", "v", side, 6).collect()}
    assert set(got) == {"hot", "b"}
    mine = [(i, v) for k, i, v, _ in rows if k == "hot" and not (v is not None and v != v)]
    vs = [v for _, v in mine if v is not None]
    assert got["hot"]["rows"] == len(mine) and got["hot"]["label"] == "H"
    assert abs(got["hot"]["mean"] - sum(vs) / len(vs)) < 1e-9 and got["hot"]["highest"] == max(vs)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, id long, v double")
    side = spark.createDataFrame([("a", "A")], "k string, label string")
    assert top_per_key(df, "k", "v", "id", 3, side, 4).collect() == []
    assert top_per_key(spark.createDataFrame([("a", 1, 0.5)], "k string, id long, v double"), "k", "v", "id", 3, side.limit(0), 4).collect() == []


def test_sides_meet_rows_where_they_lie(spark):
    df = spark.createDataFrame(data(), "k string, id long, v double, x string")
    plan = plan_shards(df, "k", 6)
    side = spark.createDataFrame([("hot", "H"), ("b", "B"), ("e", "E")], "k string, label string")
    met = matched(df, side, "k", "id", plan)
    assert met.count() == df.where("k in ('hot', 'b')").count()
    assert met.where("k = 'hot'").select("_task").distinct().count() == len(set(plan.places["hot"]))
    copies = replicate(side, "k", plan).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in copies} == {"hot": len(plan.places["hot"]), "b": len(plan.places.get("b", [0])), "e": 1}
