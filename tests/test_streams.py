import __spark_entry__ as E
from test_track_queries import events


def test_distinct_users_by_day_are_exact(spark, tmp_path):
    rows = [(i, i % 6007, 24 * (i % 2), 1.0) for i in range(14000)]
    want = sorted(len({u for _, u, f, _ in rows if f == x}) for x in (0, 24))
    got = [r["users"] for r in E.queries()["stream_distinct_late"](spark, events(spark, tmp_path, rows)).collect()]
    assert sorted(got) == want
