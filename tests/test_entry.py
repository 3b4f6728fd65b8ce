import os
import re

import pytest

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(callable(f) for f in E.queries().values())
    if os.path.isdir(DATA):
        assert E.entry(spark).columns == ["video_id", "category", "kind", "startframe", "endframe"]


def test_nothing_but_the_entry_knows_the_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "framelake")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"framelake\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p6_found", "pair_iou_join", "frame_labels", "stream_count_clip", "noactivity_gaps"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    cur = con.execute(E.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    norm = lambda row: tuple(round(v, 5) if isinstance(v, float) else str(v) for v in row)
    want = sorted(map(norm, cur.fetchall()))
    assert sorted(norm([r[c] for c in cols]) for r in E.queries()[name](spark, DATA).collect()) == want
