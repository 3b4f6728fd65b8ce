import datetime as dt
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from framelake.llm import components, cooccur, golden, overlap, raking, splits
from framelake.llm.common import identity_number, instance_key

FACE = "face_id long, wordnetid string, category string, filename string, photo_id string, ingested_at timestamp"
WHO = "wordnetid string, person_name string, same_as string, n_listed int"
T = dt.datetime(2024, 1, 1)


def faces():
    path = lambda n: f"/faces/train/{n}/0001_01.jpg"
    rows = [
        (1, "n00000005", None, path("misc"), "ph-kaaaaa1", T),
        (2, '"N5"', None, path("misc"), None, T),
        (3, "unknown", "ada_first 7", path("misc"), " PH-KAAAAA1 ", T),
        (4, None, "face", path("N00000009"), "ph-k000000", T),
        (5, "wn:n00000011", None, path("misc"), "ph-k000000", T),
        (6, "n", "-", path("misc"), "ph-kbbbbb2", T),
        (7, "n00000013", None, None, "none", T),
        (8, "n-13", None, None, "", T),
        (9, "n00000021", None, None, "x y z", T),
        (10, "n00000031", None, None, "ph-kabcde0", T),
        (11, "n00000033", None, None, "PH-KABCDE0", T),
    ]
    who = [("n00000007", "Ada First 7", None, 1), ("n00000005", "Bo Two 5", None, 1), ("n00000009", "C 9", "n00000077", 0), ("n00000077", "D 77", None, 0), ("n00000011", "E 11", "n00000077", 0), (None, None, "n00000001", 0)]
    return rows + rows[:2], who


def test_ties_through_photos_and_steps(spark):
    rows, who = faces()
    f, w = spark.createDataFrame(rows, FACE), spark.createDataFrame(who, WHO)
    got = {r["face_id"]: r["group_id"] for r in splits.found(f, w).collect()}
    assert got == {1: "n00000005", 2: "n00000005", 3: "n00000005", 4: "n00000009", 5: "n00000009", 10: "n00000031", 11: "n00000031"}
    s = {r["face_id"]: r["split"] for r in splits.face_splits(f, w, {"train": 0.5, "val": 0.25, "test": 0.25}).collect()}
    assert set(s) == {1, 2, 3, 4, 5, 7, 8, 9, 10, 11} and s[10] == s[11] and s[1] == s[2] == s[3] and s[4] == s[5] and s[7] == s[8]
    assert splits.found(f.limit(0), w).collect() == [] and splits.face_splits(f, w.limit(0), {"train": 1.0}).count() == 9
    assert splits.face_splits(f.limit(0), w.limit(0), {"train": 1.0}).collect() == []


def test_identity_numbers(spark):
    texts = {"n00000707": 707, "N707": 707, "n-00000707": 707, "subject_n00000707": 707, "n00000707/": 707, "wn:n00000707": 707, " n00000707 ": 707, '"n00000707"': 707, "nan": None, "n": None, "-": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", identity_number("t").alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == texts


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(80)] + [(7, 7), (None, 3), (5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long"), "u", "v").collect() == []


def test_allocation_meets_quotas():
    rnd = random.Random(1)
    bundles = [splits.Bundle(s, x, rnd.randrange(1, 200)) for s in (1, 2, 3, 5, 8, 40) for x in "ab"] + [splits.Bundle(3000, "a", 1)]
    shares = {"train": 800, "val": 100, "test": 100}
    plan = splits.allocate(bundles, shares)
    total, got = sum(b.size * b.n for b in bundles), Counter()
    for b in bundles:
        parts = plan[b.size, b.label]
        assert sum(k for _, k in parts) == b.n
        for s, k in parts:
            got[s] += k * b.size
    assert plan[3000, "a"] == [("train", 1)]
    for s in shares:
        assert abs(got[s] - total * shares[s] / 1000) <= 8


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    baskets = [sorted(rnd.sample(range(8), rnd.randrange(0, 5))) for _ in range(200)] + [None, [], [3, 3] and [3]]
    df = spark.createDataFrame([(b, "x") for b in baskets], "items array<int>, item string")
    one, two, n = Counter(), Counter(), 0
    for b in baskets:
        if b:
            n += 1
            one.update(b)
            two.update(combinations(b, 2))
    got = {(r["a"], r["b"]): r for r in cooccur.associations(df, "items").collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == dict(two)
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n"]) == (one[a], one[b], n)
        k = [[two[a, b], one[a] - two[a, b]], [one[b] - two[a, b], n - one[a] - one[b] + two[a, b]]]
        g = 2 * sum(v * math.log(v * n / (sum(k[i]) * (k[0][j] + k[1][j]))) for i in (0, 1) for j in (0, 1) if (v := k[i][j]))
        assert abs(abs(r["llr"]) - g) < 1e-6
    s = {r["item"]: r["stripe"] for r in cooccur.stripes(df, "items").collect()}
    assert s[-1][-1] == n and s[0][0] == one[0]
    assert cooccur.associations(df.limit(0), "items").collect() == []


def test_golden_sample(spark):
    rows = [("a", i, "k") for i in range(20000)] + [("b", i, "k") for i in range(500)] + [(None, 1, "k"), ("a", None, "k"), ("a", 5, "again")]
    df = spark.createDataFrame(rows, "s string, n long, rank string")
    a = {tuple(r) for r in golden.golden_sample(df, "s", "n", 0.1).collect()}
    assert a == {tuple(r) for r in golden.golden_sample(df.repartition(13), "s", "n", 0.1).collect()}
    assert {tuple(r) for r in golden.golden_sample(df.where("n < 900"), "s", "n", 0.1).collect()} == {r for r in a if r[1] < 900}
    assert a < {tuple(r) for r in golden.golden_sample(df, "s", "n", 0.2).collect()}
    for lo in range(0, 20000, 1000):
        assert abs(sum(1 for s, n, k in a if s == "a" and lo <= n < lo + 1000 and k == "k") - 100) <= 3
    assert golden.golden_sample(df, "s", "n", 0.0).count() == 0 and golden.golden_sample(df, "s", "n", 1.0).count() == len(rows) - 2


def test_instance_keys(spark):
    texts = {"harborset:00000792": ("harborset", 792), "HARBORSET#792": ("harborset", 792), " harborset/792 ": ("harborset", 792), "Streetwalk2:train:00217": ("streetwalk2", 217), "792": None, "harborset": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", instance_key("t").alias("k"))
    assert {r["t"]: r["k"] and tuple(r["k"]) for r in df.collect()} == texts


def test_raked_sample(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0] * 7 + [1, 2, None]), sorted(rnd.sample([10, 11, 12], rnd.randrange(0, 3)))) for i in range(6000)] + [(6000, 3, []), (6001, None, None)]
    df = spark.createDataFrame(rows, "id long, code int, codes array<int>").withColumn("codes", F.coalesce("codes", F.array().cast("array<int>")))
    mk = lambda f, k, c, p, m: raking.Target(f, k, c, p / 1000, p, m)
    targets = [mk("category", "zero", 0, 300, 1), mk("category", "one", 1, 300, 1), mk("category", "rare", 3, 1, 1), mk("tag", "ten", 10, 600, 1), mk("tag", "none", -1, 10, 2), mk("category", "much", 2, 900, 1)]
    sample, report = raking.matched_sample(df, "id", targets[:5], 600)
    s, rep = sample.collect(), {r["key_name"]: r for r in report.collect()}
    assert 600 <= len(s) <= 605 and len({r["id"] for r in s}) == len(s)
    share = lambda f: sum(map(f, s)) / len(s)
    assert abs(share(lambda r: r["code"] == 0) - 0.3) < 0.06 and abs(share(lambda r: r["code"] == 1) - 0.3) < 0.06 and abs(share(lambda r: 10 in r["codes"]) - 0.6) < 0.07
    assert rep["rare"]["sampled"] == 1 and rep["rare"]["available"] == 1 and rep["rare"]["residual"] == 0
    assert rep["none"]["available"] == 0 and rep["none"]["required"] == 6 and rep["none"]["residual"] == 6
    again, _ = raking.matched_sample(df.repartition(7), "id", targets[:5], 600)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in s}
    _, short = raking.matched_sample(df, "id", targets, 3000)
    bad = {r["key_name"] for r in short.where("exhausted").collect()}
    assert bad == {"none", "rare", "much", "one"} == {r["key_name"] for r in short.where("available < required").collect()}
    assert {(r["sampled"], r["residual"]) for r in short.where("exhausted").collect()} == {(r["available"], r["required"] - r["available"]) for r in short.where("exhausted").collect()}
    e, r0 = raking.matched_sample(df.limit(0), "id", targets, 0)
    assert e.collect() == [] and all(r["available"] == 0 for r in r0.collect())


def test_raking_in_tasks_as_on_the_driver(spark, monkeypatch):
    rnd = random.Random(7)
    cells = spark.createDataFrame([([rnd.randrange(3), *sorted(rnd.sample([3, 4], rnd.randrange(3)))], rnd.randrange(1, 90)) for _ in range(40)], "ids array<int>, n long")
    mk = lambda f, p: raking.Target(f, "", 1, p / 1000, p, 0)
    targets = [mk("category", 300), mk("category", 200), mk("tag", 500), mk("tag", 100)]
    held = raking.rake(cells, targets)
    monkeypatch.setattr(raking, "HELD_PROFILES", 0)
    assert all(abs(a - b) < 1e-9 * a for a, b in zip(held, raking.rake(cells, targets)))


def test_significance_never_drops_a_lifted_pair():
    for n in (20, 100, 10**6):
        for ab in (5, 6, 9):
            for a in range(ab, min(n // 3, 60)):
                b = ab * n // (3 * a)
                if b >= ab and ab * n >= 3 * a * b and n - a - b + ab >= 0:
                    k = [[ab, a - ab], [b - ab, n - a - b + ab]]
                    g = 2 * sum(v * math.log(v * n / (sum(k[i]) * (k[0][j] + k[1][j]))) for i in (0, 1) for j in (0, 1) if (v := k[i][j]))
                    assert g >= cooccur.SIGNIFICANT


def letters(a, b):
    """Edits of letters only; digits are never edited."""
    cost = lambda ch: 9 if ch.isdigit() else 1
    prev = [0]
    for y in b:
        prev.append(prev[-1] + cost(y))
    for x in a:
        cur = [prev[0] + cost(x)]
        for j, y in enumerate(b):
            cur.append(min(prev[j] + (0 if x == y else max(cost(x), cost(y))), prev[j + 1] + cost(x), cur[j] + cost(y)))
        prev = cur
    return prev[-1]


def forms(spark, rows):
    """Distinct (category, flat, digits) of (category, name)."""
    flat, _, digits = overlap.name_form("name")
    df = spark.createDataFrame(rows, "category int, name string")
    return df.select("category", flat.alias("flat"), digits.alias("digits")).distinct()


def test_near_names_against_brute_force(spark):
    rnd = random.Random(8)
    words = ["oak", "mica", "fern", "dusk", "k07a63", "kz9chdz00", "img", "0042", "f0201", "loft"]

    def name(n):
        s = list("_".join(rnd.choice(words) for _ in range(n)))
        return "".join(s)

    def hurt(s):
        s = list(s)
        for _ in range(rnd.randrange(0, 4)):
            at = [i for i, ch in enumerate(s) if ch.isalpha()]
            i = rnd.choice(at)
            s[i : i + 1] = rnd.choice([[], ["q"], [s[i], "x"]])
        return "".join(s)

    base = sorted({name(rnd.choice([1, 2, 3, 4, 4, 5])) for _ in range(60)})
    base = [b for b in base if any(ch.isalpha() for ch in b)]
    other = sorted({hurt(rnd.choice(base)) for _ in range(160)})
    other = [o for o in other if o.strip("_")]
    t = forms(spark, [(1, b) for b in base] + [(2, b) for b in base[:5]])
    e = forms(spark, [(1, o) for o in other])
    flat = lambda s: s.replace("_", "")
    want = {(flat(a), flat(b)) for a in base for b in other if letters(flat(a), flat(b)) <= 2}
    rows = overlap.near_names(t, e).collect()
    assert want == {(r["train_name"], r["held_name"]) for r in rows} and len(want) == len(rows)
    assert all(r["containment"] == 1 for r in rows if r["train_name"] == r["held_name"]) and min(r["containment"] for r in rows) > 0.3


def test_core_names(spark):
    same = ["/data/x/train/1/oak_fern_k1a00.jpg", "D:\\reup\\x\\Oak Fern K1A00.JPG", "b/oak-fern-k1a00-scaled.webp", "oak%20fern%20k1a00 (1).png", "Copy of oak.fern.k1a00_640x480.jpg", "OAK_FERN_K1A00 - Copy.png", "oak_fern_k1a00@2x.jpg", "oak_fern_k1a00_copy2.jpeg", "oak_fern_k1a00_thumb.jpg"]
    df = spark.createDataFrame([(s,) for s in [*same, "oak_fern_k1a01.jpg", None, ""]], "filename string").select(overlap.name_form(overlap.core_name("filename"))[1].alias("name"))
    got = [r["name"] for r in df.collect()]
    assert set(got[: len(same)]) == {"oakfernk111a000000"} and got[len(same)] == "oakfernk111a000111" and got[-2] is None and got[-1] == ""


def test_cross_split_pairs(spark):
    schema = "id long, split string, source string, number long, category int, name string, h string"
    rows = [(1, "train", "a", 5, 1, "oak_fern_dusk_k1", ""), (2, "val", "a", 5, 2, "other", ""), (3, "test", None, None, 1, "oak_fern_dukk_k1", ""), (4, "test", None, None, 1, "oak_fern_dusk_k2", ""), (5, None, "a", 5, 1, "oak_fern_dusk_k1", ""), (6, "val", "a", 5, 1, "oak_fern_dusk_k1", ""), (7, "train", None, 5, None, None, "")]
    got = {(r["train_id"], r["held_id"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 2), (1, 3), (1, 6)}
    assert overlap.cross_split_pairs(spark.createDataFrame([], schema)).collect() == []


def test_stripes_leave_a_task_added_up(spark):
    baskets = spark.createDataFrame([([1, 2, 3],), ([2, 3],), ([],), (None,), ([3],)], "items array<int>")
    s = cooccur.stripes(baskets, "items")
    assert {r["item"]: r["stripe"] for r in s.collect()} == {-1: {-1: 3, 1: 1, 2: 2, 3: 3}, 1: {1: 1, 2: 1, 3: 1}, 2: {2: 2, 3: 2}, 3: {3: 3}}
    assert "Generate" not in s._jdf.queryExecution().executedPlan().toString()  # no row a pair and basket


def test_near_names_with_other_separators(spark):
    pairs = [("dusk_grain_kipesgm00", "dusk_grainkipesgn00"), ("img_0012", "imgg0012"), ("oak_a_fern07", "oak_fern07"), ("k07a63_f0201_loft", "k07a63f0201_lofft"), ("oak_mica_7", "o-akmca7")]
    rows = overlap.near_names(forms(spark, [(1, a) for a, _ in pairs]), forms(spark, [(1, b) for _, b in pairs])).collect()
    flat = lambda s: "".join(ch for ch in s if ch.isalnum())
    assert {(r["train_name"], r["held_name"]) for r in rows} == {(flat(a), flat(b)) for a, b in pairs}


def test_short_names_and_a_letter_at_each_place(spark):
    names = ["a", "ab", "abc", "abcd", "x", "xyz1", "abcdefghi"]
    near = sorted({b[:i] + x + b[j:] for b in ["abcdefghi"] for i in range(10) for j in (i, i + 1, i + 2) for x in ("", "q", "qq") if j <= 9})
    rows = overlap.near_names(forms(spark, [(1, n) for n in names]), forms(spark, [(1, n) for n in names + near])).collect()
    want = {(a, b) for a in names for b in {*names, *near} if letters(a, b) <= 2}
    assert {(r["train_name"], r["held_name"]) for r in rows} == want
