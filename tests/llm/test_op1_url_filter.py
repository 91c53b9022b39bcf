"""URL filters: interval and as-of cases."""

import datetime as dt

from pyspark.sql import functions as F

from stockledger.llm import url_filter as U

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
ENTRIES = [
    ("l1", "block", "bad.example", "add", DAY(5)), ("l1", "block", "bad.example", "remove", DAY(10)), ("l1", "block", "bad.example", "add", DAY(20)),
    ("l1", "block", "bad.example", "add", DAY(20)), ("l2", "allow", "ok.bad.example", "add", DAY(0)), ("l3", "block", "ok.bad.example/p/q", "add", DAY(0)),
    ("l4", "block", "tie.example", "add", DAY(3)), ("l4", "block", "tie.example", "remove", DAY(3)), ("l5", "block", None, "add", DAY(0)),
    ("l5", "block", "x.example", None, DAY(0)), ("l5", "block", "x.example", "add", None), ("l6", "block", "both.example", "add", DAY(0)),
    ("l7", "allow", "both.example", "add", DAY(0))]
CASES = [
    ("http://bad.example/", 4, 0, False), ("http://bad.example/", 5, 1, True), ("http://www.BAD.example:80/x", 9, 1, True),
    ("http://bad.example", 10, 0, False), ("https://u:p@bad.example./?q", 20, 1, True), ("http://notbad.example/", 7, 0, False),
    ("http://ok.bad.example/p", 7, 2, False), ("http://ok.bad.example/p/q/r", 7, 3, True), ("http://a.ok.bad.example/p/qq", 7, 2, False),
    ("http://tie.example/", 3, 0, False), ("http://x.example/", 9, 0, False), ("http://both.example", 1, 2, False), (None, 7, 0, False),
    ("not a url", 7, 0, False), ("http:///path", 7, 0, False), ("http://bad.example/" + "s/" * 5000, 7, 1, True)]


def test_cases_broadcast_and_shuffled(spark):
    rows = [(i, u, DAY(n)) for i, (u, n, _, _) in enumerate(CASES)] + [(None, CASES[1][0], DAY(5)), (1, CASES[1][0], DAY(5)), (77, CASES[1][0], None)]
    want = [(i, n, b) for i, (_, _, n, b) in enumerate(CASES)] + [(None, 1, True), (1, 1, True), (77, 0, False)]
    c = spark.createDataFrame(rows, "id long, url string, fetched date").withColumn("list", F.lit("clash")).withColumn("copies", F.lit(9))
    e = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, effective date").withColumn("id", F.lit(0))
    for size in (U.BROADCAST_BYTES, 0):
        got = U.apply_lists(c, e, broadcast_bytes=size)
        assert sorted(((r.id, r.n_active, r.blocked) for r in got.collect()), key=str) == sorted(want, key=str)
        plan = got._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_intervals(spark):
    e = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, effective date")
    got = {(r.valid_from, r.valid_to) for r in U.intervals(e).where("pattern = 'bad.example'").collect()}
    assert got == {(DAY(5), DAY(10)), (DAY(20), None)}


def test_empty_tables(spark):
    c = spark.createDataFrame([(1, "http://a.example", DAY(0))], "id long, url string, fetched date")
    e = spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, effective date")
    assert [r.blocked for r in U.apply_lists(c, e.where("false")).collect()] == [False]
    assert U.apply_lists(c.where("false"), e).count() == 0
