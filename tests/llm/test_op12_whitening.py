"""Whitening against numpy's eigenvectors and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockledger.llm import whitening as W


def brute(rows):
    """rows: (id, vector) -> n, sums, {row number: (deviation, x)}, eigenvalues (falling), components."""
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in used), default=0)
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in used]
    fits = sorted(set(map(tuple, xs)))
    n = len(fits)
    sums = [sum(c) for c in zip(*fits)]
    exact = [[sum(Fraction(f[a] * n - sums[a], n) * Fraction(f[b] * n - sums[b], n) for f in fits) / n for b in range(dims)] for a in range(dims)]
    e, v = np.linalg.eigh(np.array([[float(c) for c in r] for r in exact]).reshape(dims, dims)) if dims else (np.zeros(0), np.zeros((0, 0)))
    return n, sums, [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), x) for (i, _), x in zip(used, xs)], e[::-1], v[:, ::-1]


def run(spark, rows, **kw):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    each = W.integer_vectors(d)
    model = W.fit(W.fit_list(each), **kw)
    return model, W.whiten(each, model).collect()


def compare(spark, rows, want_components):
    model, got = run(spark, rows)
    n, sums, used, e, v = brute(rows)
    assert len(got) == len(used) * want_components
    assert (model.n, list(model.sums)) == (n, sums) and model.identity_error <= 1e-9
    np.testing.assert_allclose(model.explained, e[:want_components] / e.sum(), rtol=1e-9)
    mean = np.array(sums) / n
    for c in range(want_components):
        own = sorted((r.id, int(r.deviation), r.whitened) for r in got if r.component == c + 1)
        one = [(i, dev, float((np.array(x) - mean) @ v[:, c] / math.sqrt(e[c]))) for i, dev, x in used]
        sign = max(one, key=lambda r: abs(r[2]))
        sign = 1 if min(abs(r[2] - sign[2]) for r in own) < min(abs(r[2] + sign[2]) for r in own) else -1
        one = sorted((i, dev, sign * w) for i, dev, w in one)
        assert [r[:2] for r in own] == [r[:2] for r in one]
        np.testing.assert_allclose([r[2] for r in own], [r[2] for r in one], rtol=1e-8, atol=1e-8)


def test_random_rows_with_copies_and_unusable_ones(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(5, rows[7][1])] * 2
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5), (2004, [-0.0] * 6), (2005, [1.0, 2.0]), (2006, [])]
    compare(spark, rows, 4)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(2)
    # few rows in many dimensions, one dimension constant, two equal
    compare(spark, [(i, [7.5, *a, a[0], *rng.normal(size=20).tolist()]) for i, a in enumerate(rng.normal(size=(9, 3)).tolist())], 4)
    # two directions only
    base = rng.integers(-50, 50, size=(60, 2))
    compare(spark, [(i, [float(a), float(b), float(a + b), float(a - b), float(2 * a)]) for i, (a, b) in enumerate(base.tolist())], 2)


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(3)
    scale = 10.0 ** -np.arange(5)
    compare(spark, [(i, (rng.normal(size=5) * scale * 1000).tolist()) for i in range(300)], 4)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        model, got = run(spark, rows)
        assert model is None and got == []


def test_exact_deviation_beyond_64_bits():
    x = np.array([[2 ** 62, -(2 ** 62)], [3, 4]], dtype=np.int64)
    assert W.deviations(x, 3, (2 ** 60, 5)) == [(3 * 2 ** 62 - 2 ** 60) ** 2 + (3 * -(2 ** 62) - 5) ** 2, (9 - 2 ** 60) ** 2 + 49]
    assert W.deviations(x[1:], 3, (1, 5)) == [64 + 49]


def test_substitution_inverts():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(8, 8))) + 5 * np.eye(8)
    a = rng.normal(size=(20, 8))
    np.testing.assert_allclose(W.solve(a, r) @ r, a, atol=1e-12)


@pytest.mark.parametrize("fan", [1, 32])
def test_added_over_any_fan(spark, monkeypatch, fan):
    monkeypatch.setattr(W, "FAN_IN", fan)
    d = spark.range(500).select(F.array("id", F.col("id") * 2).alias("x")).repartition(9)
    out = W._added(d, lambda bs: [sum((b.sum(axis=0) for b in bs), np.zeros(2))], 2)
    assert out[0].tolist() == [sum(range(500)), 2 * sum(range(500))]


def test_query_on_given_table(spark):
    import os

    import duckdb
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("test tables absent")
    got = W.op12_whitening(spark, sf).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    n, _, used, e, _ = brute(rows)
    assert len(got) == 4 * len(used) and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() <= 1e-4
    assert {(r.vec_id, r.deviation) for r in got} == {(i, dev) for i, dev, _ in used}
    for r in got:
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
