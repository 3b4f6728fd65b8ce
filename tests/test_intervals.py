import random
from collections import defaultdict

import pytest

from framelake.operators.intervals import periods_and_gaps

SCHEMA = "video long, category string, s int, e int, kind string, _e0 long"


def brute(rows):
    by = defaultdict(list)
    for v, c, s, e, *_ in rows:
        if s is not None and e is not None and e > s:
            by[v, c].append((s, e))
    out = []
    for (v, c), spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(v, c, "period", s, e) for s, e in merged]
        out += [(v, c, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


def run(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA)
    got = periods_and_gaps(df, ["video", "category"], "s", "e", block)
    return sorted((tuple(r[c] for c in ("video", "category", "kind", "s", "e")) for r in got.collect()), key=str)


@pytest.mark.parametrize("block", [3, 1000])
def test_against_brute_force(spark, block):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", None]), (s := rnd.randrange(300)), s + rnd.randrange(-2, 12), "x", 7) for _ in range(300)]
    rows += [(1, "a", 0, 299, "x", 7), (3, "a", 5, 5, "x", 7), (3, "a", None, 5, "x", 7), (3, "a", 5, None, "x", 7)]
    rows += rows[:20]
    assert run(spark, rows, block) == brute(rows)


def test_touching_nested_and_far(spark):
    rows = [(1, "a", 0, 10, "", 0), (1, "a", 10, 12, "", 0), (1, "a", 2, 3, "", 0), (1, "a", 20, 30, "", 0)]
    assert run(spark, rows, 1) == [(1, "a", "gap", 12, 20), (1, "a", "period", 0, 12), (1, "a", "period", 20, 30)]


def test_empty(spark):
    assert run(spark, [], 10) == []
