"""Mixing: targets, balancing and rounding against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stockledger.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets of ordered source sizes: cap the sources over their limit, share the rest again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    done, free = {}, set(range(len(sizes)))
    while free:
        left = sum(sizes) - sum(done.values())
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total >= cap * sizes[i]}
        if not over:
            return [done.get(i, left * w[i] / total) for i in range(len(sizes))]
        done |= {i: cap * sizes[i] for i in over}
        free -= over
    return [done[i] for i in range(len(sizes))]


def corpus():
    rng = random.Random(6)
    rows = []
    for s, n in (("b", 200), ("a", 3), ("é", 60), (None, 40), ("", 25), ("big", 900)):
        rows += [(len(rows) + i, " ".join("w" * (1 + i % 3) for i in range(int(rng.paretovariate(1.1) * 4))), s) for i in range(n)]
    rows += [(5000, None, "b"), (5001, "", "nothing"), (None, "a b c", "b"), (7, rows[7][1], rows[7][2]), (5002, "copy of this", "big")]
    rows += [(6000 + i, "copy of this", "big") for i in range(500)]
    return rows


def test_plan(spark, monkeypatch):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("id", F.lit(1))
    size = lambda t: len((t or "").split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    want = dict(zip(names, fill([total[n] for n in names])))
    for bucket in (M.BUCKET_ROWS, 16):
        monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
        got = M.plan(d).collect()
        assert sorted(((r.id, r.source, r.size) for r in got), key=str) == sorted(((i, s, size(t)) for i, t, s in rows), key=str)
        for n in names:
            own = [r for r in got if r.source == n]
            assert all(math.isclose(r.target, want[n], abs_tol=1e-6) and r.source_size == total[n] for r in own)
            assert all(r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size for r in own)
            assert abs(sum(r.taken for r in own) - want[n]) <= max(2, 0.01 * want[n]), n
        # documents of one source and size differ by one copy at most
        cells = {}
        for r in got:
            if r.size:
                cells.setdefault((r.source, r.size), []).append(r.copies)
        assert all(max(c) - min(c) <= 1 for c in cells.values())
    again = sorted(map(tuple, M.plan(d.repartition(5)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("dense", [True, False])
def test_two_margins_settle_and_contradictions_raise(spark, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(M, "DENSE_KEYS", 0)
    cells = spark.createDataFrame([(0, 0, 100.0), (0, 1, 300.0), (1, 0, 200.0), (1, 1, 50.0)], "a int, b int, tokens double")
    a = spark.createDataFrame([(0, 250.0), (1, 400.0)], "key int, target double")
    b = spark.createDataFrame([(0, 500.0), (1, 150.0)], "key int, target double")
    lam = M.balance(cells, {"a": a, "b": b})
    la, lb = ({r.key: r.lam for r in lam[m].collect()} for m in ("a", "b"))
    rate = {(r.a, r.b): r.tokens * math.exp(la[r.a] + lb[r.b]) for r in cells.collect()}
    assert math.isclose(rate[0, 0] + rate[0, 1], 250, rel_tol=1e-6) and math.isclose(rate[0, 0] + rate[1, 0], 500, rel_tol=1e-6)
    with pytest.raises(RuntimeError):
        M.balance(cells, {"a": a, "b": spark.createDataFrame([(0, 900.0), (1, 150.0)], "key int, target double")}, max_rounds=4 if dense else 1)


def test_correlated_margins_settle_in_few_rounds(spark):
    """Margins that nearly coincide: a solvable problem on which steps of one margin at a time creep."""
    tokens = {(0, 0): 1000.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1000.0}
    la, lb = (0.7, -0.4), (0.2, -0.9)
    mixed = {k: x * math.exp(la[k[0]] + lb[k[1]]) for k, x in tokens.items()}
    cells = spark.createDataFrame([(a, b, x) for (a, b), x in tokens.items()], "a int, b int, tokens double")
    margin = lambda i: spark.createDataFrame([(k, sum(x for c, x in mixed.items() if c[i] == k)) for k in (0, 1)], "key int, target double")
    lam = M.balance(cells, {"a": margin(0), "b": margin(1)}, max_rounds=20)
    got = [{r.key: r.lam for r in lam[m].collect()} for m in ("a", "b")]
    for (a, b), x in mixed.items():
        assert math.isclose(tokens[a, b] * math.exp(got[0][a] + got[1][b]), x, rel_tol=1e-4)


def test_three_margins_with_many_keys(spark):
    rng = random.Random(9)
    tokens = {(a, b, c): rng.expovariate(0.01) for a in range(7) for b in range(5) for c in range(3) if rng.random() < 0.7}
    lam = [[rng.uniform(-1, 1) for _ in range(n)] for n in (7, 5, 3)]
    mixed = {k: x * math.exp(sum(lam[i][k[i]] for i in range(3))) for k, x in tokens.items()}
    cells = spark.createDataFrame([(*k, x) for k, x in tokens.items()], "a int, b int, c int, tokens double")
    sums = lambda i, t: {n: sum(x for k, x in t.items() if k[i] == n) for n in {k[i] for k in t}}
    found = M.balance(cells, {m: spark.createDataFrame(list(sums(i, mixed).items()), "key int, target double") for i, m in enumerate("abc")}, max_rounds=20)
    got = [{r.key: r.lam for r in found[m].collect()} for m in "abc"]
    tilted = {k: x * math.exp(sum(got[i][k[i]] for i in range(3))) for k, x in tokens.items()}
    for i in range(3):
        assert all(math.isclose(sums(i, tilted)[n], x, rel_tol=1e-6) for n, x in sums(i, mixed).items())


def test_rows_without_ids_are_spread(spark):
    """20,000 rows of one size without an id: taken as a whole like any, and no bucket holds more than a few hundred."""
    d = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"),
                                   F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    got = M.plan(d).groupBy("source", "copies").count().collect()
    taken = {s: sum(r.copies * r["count"] for r in got if r.source == s) * 4 for s in "xy"}
    assert sum(r["count"] for r in got) == 20_000 and abs(taken["x"] - 80_000 * 5 / 7) <= 4 and abs(taken["y"] - 80_000 * 2 / 7) <= 4
    assert all(max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s) <= 1 for s in "xy")


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__key", F.lit("k")).withColumn("__COPIES", F.lit(2))
    out = M.mix(d)
    assert out.columns == [*d.columns, "mix_copy"]
    taken = sum(r.taken for r in M.plan(d).collect())
    assert sum(len((r.text or "").split()) for r in out.collect()) == taken


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.plan(d).count() == 0 and M.mix(d).count() == 0
