from datetime import datetime as dt

from artiscope.llm import url_filters as uf

EVENTS = "list_name string, kind string, entry string, action string, at timestamp"
CAPS = "page_id long, url string, fetched_at timestamp"


def day(n):
    return dt(2024, 1, n)


def test_intervals(spark):
    rows = [("block", "host", "A.com", "add", day(1)), ("block", "host", "a.com", "add", day(2)), ("block", "host", "a.com", "remove", day(5)), ("block", "host", "a.com", "remove", day(5)), ("block", "host", "a.com", "add", day(9)), ("block", "host", "b.com", "add", day(3)), ("block", "host", "b.com", "remove", day(3)), ("x", "host", "c.com", "remove", day(3)), ("x", "host", "c.com", "huh", day(1)), ("x", "host", None, "add", day(1))]
    got = sorted((r.entry, r.valid_from, r.valid_to) for r in uf.intervals(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == [("a.com", day(1), day(5)), ("a.com", day(9), None)]


def test_captures_are_judged_as_of_their_fetch(spark):
    events = spark.createDataFrame([("block", "domain", "bad.com", "add", day(5)), ("block", "domain", "bad.com", "remove", day(10)), ("allow", "prefix", "www.bad.com/ok", "add", day(1)), ("block", "host", "h.org", "add", day(2))], EVENTS)
    caps = [(1, "http://www.BAD.com/x", day(4)), (2, "http://www.bad.com/x", day(5)), (3, "http://www.bad.com/x", day(10)), (4, "https://u@www.bad.com:8/ok/z?q", day(6)), (5, "http://notbad.com/", day(6)), (6, "http://h.org", day(3)), (6, "http://h.org", day(3)), (7, None, day(3)), (8, "http://h.org", None), (9, "nonsense", day(3)), (None, "http://h.org/", day(9))]
    got = {r.page_id: r for r in uf.evaluate(spark.createDataFrame([(*c, "z") for c in caps], CAPS + ", kind string"), events).collect()}
    assert len(got) == 10
    assert [k for k, r in got.items() if r.blocked and k] == [k for k in got if k in (2, 6)] and got[None].blocked
    assert got[4].n_active == 2 and got[4].matched == "allow/prefix/www.bad.com/ok block/domain/bad.com" and not got[4].blocked
    assert got[1].n_ever == 1 and got[1].n_active == 0 and got[6].n_rows == 2 and got[8].n_active == 0 and got[8].n_ever == 0 and got[7].n_ever == 0


def test_hot_key_is_salted_and_loses_nothing(spark):
    caps = spark.range(4000).selectExpr("id as page_id", "if(id % 3 = 0, concat('http://hot.com/', id), concat('http://h', id, '.net/')) as url", "timestamp'2024-01-03' as fetched_at")
    events = spark.createDataFrame([("block", "host", "hot.com", "add", day(1)), ("block", "host", "h1.net", "add", day(1))], EVENTS)
    assert uf.evaluate(caps, events).where("blocked").count() == 1334 + 1
    assert uf.evaluate(caps, events.limit(0)).where("n_ever > 0").count() == 0
    assert uf.evaluate(caps.limit(0), events).count() == 0


def test_deep_paths_meet_entries_of_any_depth(spark):
    events = spark.createDataFrame([("block", "prefix", "a.com/x", "add", day(1)), ("block", "prefix", "a.com/x/y/z", "add", day(1)), ("block", "prefix", None, "add", day(1))], EVENTS)
    caps = spark.createDataFrame([(1, "http://a.com/x/y/z" + "/w" * 3000, day(2)), (2, "http://a.com/x/y", day(2)), (3, "http://a.com/xy", day(2))], CAPS)
    assert {r.page_id: r.n_active for r in uf.evaluate(caps, events).collect()} == {1: 2, 2: 1, 3: 0}
