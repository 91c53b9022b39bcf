"""Byte convolutional network: gradient, folded scoring, held-out accuracy and odd cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockledger.llm import language as L

SF = "/root/testdata/sf0.01"
SMALL = L.Config(width=12, dim=3, filters=4, seed=3)


def loss(m, x, y):
    out = 0.0
    e = m.emb[x]
    for row, target in zip(e, y):
        h = []
        for k, w in zip(L.KERNELS, m.kernels):
            h += list(np.max([row[i:i + k].reshape(-1) @ w for i in range(m.cfg.width)], axis=0))
        z = np.maximum(np.array(h) + m.shift, 0) @ m.out.T + m.bias
        out -= z[target] - np.log(np.exp(z).sum())
    return out / len(x)


def small_model():
    rng = np.random.default_rng(0)
    m = L.init(("a", "b", "c"), SMALL)
    m.out[:] = rng.normal(size=m.out.shape)
    m.shift[:] = rng.normal(0.5, 0.1, size=m.shift.shape)
    x = rng.integers(0, 5, (6, SMALL.width + 3)).astype(np.uint8)
    return m, x, np.array([0, 1, 2, 0, 1, 2])


def test_gradients_equal_finite_differences():
    m, x, y = small_model()
    params = [m.emb, *m.kernels, m.shift, m.out, m.bias]
    for p, g in zip(params, L.gradients(m, x, y)):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in np.random.default_rng(1).choice(min(len(flat), 15), 8):
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss(m, x, y)
            flat[i] = old - eps
            down = loss(m, x, y)
            flat[i] = old
            assert abs((up - down) / (2 * eps) - gf[i]) < 1e-4


def test_pair_tables_give_the_network():
    m, x, y = small_model()
    lp = L.Scorer(m).log_probabilities(x)
    assert abs(-lp[np.arange(len(y)), y].mean() - loss(m, x, y)) < 1e-5


def test_windows_cover_the_text():
    for n in (0, 1, 11, 12, 13, 24, 25):
        x, used = L.windows(bytes(range(1, n + 1)), 12)
        assert used.sum() == n and x.shape[1] == 12 + max(L.KERNELS) - 1
        assert b"".join(bytes(r[:u]) for r, u in zip(x, used)) == bytes(range(1, n + 1))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_held_out_accuracy(spark):
    rows = L.op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    en, de = "the cat is on the mat and the dog is in the house ", "der hund ist im haus und die katze schläft nicht "
    docs = [(i, (en if i % 2 else de) * (1 + i % 4), "en" if i % 2 else "de") for i in range(80)]
    docs += [(90, None, "en"), (91, "", "de"), (92, "12 ... !", "en"), (93, en * 4000, None), (94, "ß", "de"), (None, en, "en"), (3, docs[3][1], "en"),
             (95, "漢字", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("p", F.lit(0))
    model = L.train(d)
    got = L.identify(d, model).collect()
    assert len(got) == len(docs) and model.langs == ("de", "en")
    by = {r.id: r for r in got if r.id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (90, 91, 92))
    assert by[93].lang_pred == "en" and by[95].lang_pred in model.langs
    assert np.mean([by[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)]) > 0.95
    assert sorted(map(tuple, L.identify(d, L.train(d)).collect()), key=str) == sorted(map(tuple, got), key=str)
    nothing = L.train(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.identify(d, nothing).collect()} == {"und"}
    assert L.identify(d.where("false"), model).count() == 0


def test_rare_languages_are_learned_and_the_sample_is_bounded(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id < 20 THEN 'rare' ELSE 'en' END AS lang")
    x, y, langs = L.training_windows(docs, usable=F.lit(True), id_col="doc_id", text_col="text", lang_col="lang", cfg=L.Config(train_rows=100, windows=1))
    assert len(x) == 100 and langs == ("en", "rare") and (y == 1).sum() == 20


def test_repeated_ids_do_not_crowd_the_sample(spark):
    """Copies of one id give one text of the sample, the least; an id with two languages gives one for each."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    docs = docs.union(spark.range(3000).selectExpr("7L AS doc_id", "concat('zz copy ', id) AS text", "'b' AS lang"))
    docs = docs.union(spark.sql("SELECT 7L, 'other', 'a'"))
    x, y, langs = L.training_windows(docs, usable=F.lit(True), id_col="doc_id", text_col="text", lang_col="lang", cfg=L.Config(train_rows=500, windows=1))
    texts = [bytes(r).rstrip(b"\0").decode() for r in x]
    assert langs == ("a", "b") and len(texts) == 301 and not any(t.startswith("zz") for t in texts)
    assert sorted(texts) == sorted([f"text {i}" for i in range(300)] + ["other"])
