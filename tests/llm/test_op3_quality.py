"""Quality classifier: features, gradient, held-out accuracy and odd cases."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockledger.llm import quality_model as Q

SF = "/root/testdata/sf0.01"


def brute_ids(text, cfg):
    """Bucket counts by the definition, one feature at a time."""
    f, words = Q.Features(cfg), (text or "").encode().split()
    mult, step = int(Q._MULT), int(Q._STEP)

    def bucket(h, kind):
        h = (h + kind) * mult % 2 ** 64
        return ((h ^ (h >> 29)) * mult % 2 ** 64) >> int(f.shift)

    out, hashes = [], []
    for w in words:
        edged = b"<" + w + b">"
        h = sum((c + 1) * pow(step, i, 2 ** 64) for i, c in enumerate(edged)) % 2 ** 64
        hashes.append(h)
        out.append(bucket(h, 0))
        for k in range(cfg.min_n, cfg.max_n + 1):
            for i in range(len(edged) - k + 1):
                g = 0
                for c in edged[i:i + k]:
                    g = (g * step + c) % 2 ** 64
                out.append(bucket(g, k))
    runs = [(hashes[i], hashes[i + 1], hashes[i + 2]) for i in range(len(hashes) - 2)]
    out += [f.marker(len(words).bit_length())] * (1 + len(words) // 10)
    out += [f.echo] * (4 * sum(a == b for a, b in zip(hashes, hashes[1:]))) + [f.again] * (4 * (len(runs) - len(set(runs))))
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "Hello hello!!", "the the the the", "a b c a b c a b c", "é漢 😀 x" * 9, "w" * 500])
def test_features_are_those_defined(text, monkeypatch):
    cfg = Q.Config(buckets=1 << 12)
    want = brute_ids(text, cfg)
    for piece in (1 << 20, 5):
        monkeypatch.setattr(Q, "_PIECE", piece)
        assert sorted(np.concatenate(list(Q.Features(cfg).pieces(text))).tolist()) == want


def test_scorer_equals_average_then_softmax():
    cfg = Q.Config(buckets=256, epochs=2)
    feats = Q.Features(cfg)
    rows = [(*feats.counts(t), y) for t, y in (("good prose here", 1), ("bad bad bad", 0), ("more good prose", 1))]
    model = Q.fit(Q.Sample.of(rows), cfg)
    idx, w = feats.counts("good bad prose")
    assert np.allclose(Q.Scorer(model).probabilities("good bad prose"), Q.softmax(model.logits[:, idx] @ w + model.bias))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_held_out_accuracy(spark):
    rows = Q.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = {y: [r.predicted == y for r in rows if r.quality == y] for y in (0, 1)}
    assert np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.95, {y: np.mean(v) for y, v in right.items()}


def test_cases(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "to", "sea", "and", "back"]) for _ in range(30))
    docs = [(i, good() if i % 3 else "buy!!! " * 30) for i in range(120)]
    docs += [(500, None), (501, ""), (None, good()), (502, "word " * 200_000), (4, docs[4][1]), (504, "y" * 300_000)]
    labels = [(i, 1 if i % 3 else 0) for i in range(120)] + [(1, None), (None, 1), (7, 1), (999, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("k", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("h", F.lit("clash"))
    out = Q.score(d, Q.train(d, lab))
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= Q.THRESHOLD) == bool(r.id % 3) for r in got if r.id is not None and r.id < 120]) > 0.98
    model = Q.train(d, lab)
    assert sorted(map(tuple, Q.score(d, model).collect()), key=str) == sorted(map(tuple, got), key=str)
    none = Q.train(d, lab.where("false"))
    assert {r.score for r in Q.score(d, none).collect()} == {0.5}
    assert {r.score for r in Q.score(d, Q.train(d, lab.where("quality = 0"))).collect()} == {0.5}
    assert Q.score(d.where("false"), model).count() == 0
    assert Q.train(d.where("false"), lab).classes == (0, 1)


def test_sample_is_bounded(spark):
    d = spark.range(300).selectExpr("id AS doc_id", "concat('t ', id) AS text")
    lab = spark.range(300).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = Q.training_rows(d, lab, label="quality", usable=F.lit(True), id_col="doc_id", text_col="text", cfg=Q.Config(train_rows=40))
    assert len(rows.labels) == 40 and len(rows.starts) == 41 and rows.starts[-1] == len(rows.ids) == len(rows.weights)


def test_default_sample_takes_three_thousand_labelled_rows(spark):
    d = spark.range(3200).selectExpr("id AS doc_id", "concat('t ', id) AS text")
    lab = spark.range(3200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = Q.training_rows(d, lab, label="quality", usable=F.lit(True), id_col="doc_id", text_col="text", cfg=Q.Config())
    assert len(rows.labels) == 3000 and Q.Config().epochs == 8


def test_repeated_ids_and_labels_do_not_crowd_the_sample(spark):
    """Copies of one label and of one id give one row of the sample, the least text; other texts keep their place."""
    d = spark.range(400).selectExpr("id AS doc_id", "concat('t ', id) AS text")
    d = d.union(spark.range(2000).selectExpr("5L AS doc_id", "concat('z copy ', id) AS text"))
    lab = spark.range(400).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    repeated = lab.union(spark.range(2000).selectExpr("5L AS doc_id", "1 AS quality"))
    plain, crowded = (Q.training_rows(x, y, label="quality", usable=F.lit(True), id_col="doc_id", text_col="text", cfg=Q.Config(train_rows=300))
                      for x, y in ((d.where("text NOT LIKE 'z%'"), lab), (d, repeated)))
    assert len(crowded.labels) == 300 and crowded.labels == plain.labels
    assert np.array_equal(crowded.ids, plain.ids) and np.array_equal(crowded.weights, plain.weights)
    both = Q.training_rows(d, lab.union(spark.sql("SELECT 5L, 0")), label="quality", usable=F.col("k") == 5, id_col="doc_id", text_col="text", cfg=Q.Config())
    assert both.labels == [0, 1]
