"""Exact duplicates against brute force, with and without heavy hitters."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stockledger.llm import exact_dedup as E


def brute(rows):
    """rows: (id, text) -> sorted (id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for norm, g in groups.items():
        g.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(x[4], g[0][4], len(g), x is g[0], sha) for x in g]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit("clash")).withColumn("row", F.lit(0)).repartition(5)
    return sorted((tuple(r) for r in E.deduplicate(d, **kw).collect()), key=str)


ODD = [(5, "a b"), (3, "ab"), (9, "a\tb\n"), (2, "a  b "), (1, None), (4, ""), (8, " \x0b\x0c\r"), (None, "ab"), (None, "solo"), (7, "solo"), (6, "solo"),
       (11, "x y"), (12, "xy"), (13, "\U0001f600 \U0001f600"), (14, "\U0001f600\U0001f600"), (15, "A b"), (16, "w" * 200_000), (17, "w " * 200_000),
       (20, "twin"), (20, "twin"), (20, "t win"), (None, None), (None, "lonely")]


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_odd_rows(spark, counters):
    assert run(spark, ODD, counters=counters) == brute(ODD)


def test_hot_groups(spark):
    rng = random.Random(3)
    rows = [(i, "hot   text" if i % 3 == 0 else f"warm {i % 7}" if i % 3 == 1 else f"own {i} " + " " * rng.randrange(3)) for i in range(6000)]
    rng.shuffle(rows)
    assert run(spark, rows, counters=4) == brute(rows) == run(spark, rows)


def test_every_heavy_digest_wins_and_no_other(spark):
    rng = random.Random(4)
    rows = [(i, f"t{min(int(rng.expovariate(0.2)), 3000)}") for i in range(20000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    each = E.digests(d)
    for counters in (8, 100):
        got = {r.sha: r.group_size for r in E.verified(each, E.frequent(each, counters=counters), counters=counters).collect()}
        n = defaultdict(int)
        for _, t in rows:
            n[hashlib.sha256(t.encode()).hexdigest()] += 1
        assert got == {k: v for k, v in n.items() if v * counters > len(rows)} and got


def test_empty_table_and_plan(spark):
    assert run(spark, []) == []
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    plan = E.deduplicate(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
