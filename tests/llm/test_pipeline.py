"""Pipeline stages against the operators' brute-force forms on one small corpus."""

import importlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stockledger.llm import quality_model
from test_op10_simhash import brute_components, brute_fp
from test_op9_decontaminate import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages(spark, docs):
    """Each stage on the whole table: columns kept, decisions as the operator's."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    lang = P.language_id(spark, docs, SF)
    assert lang.columns == docs.columns and lang.count() >= 0.97 * len(texts)
    quality = {r.doc_id for r in P.quality(spark, docs, SF).collect()}
    scored = {r.id for r in quality_model.score(docs, quality_model.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
              if r.score >= quality_model.THRESHOLD}
    assert quality == scored
    first = brute_components({i: brute_fp(t) for i, t in texts.items()})
    near = P.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in first.items() if c == i)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id for r in P.decontamination(spark, docs.where("doc_id < 120"), SF).collect()}
    assert clean == {i for i, t in texts.items() if i < 120 and not brute(t, items, 10)[1]}
    mixed = P.mixing_to_weights(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "mix_copy"]


def test_clean_documents_stay_and_junk_goes(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = P.quality(spark, P.language_id(spark, docs, SF), SF).select("doc_id")
    rows = labels.join(kept.withColumn("kept", F.lit(True)), "doc_id", "left").collect()
    clean, junk = [r.kept is True for r in rows if r.quality == 1], [r.kept is True for r in rows if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_run_with_odd_rows(spark, docs, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src0", 0), (900001, None, "de", None, None),
                                 (900002, "12 34", None, "src1", 5)], docs.schema)
    twice = docs.where("doc_id = 3")
    extra = docs.unionByName(odd).unionByName(twice).unionByName(twice.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("__keep", F.lit("x")).withColumn("score", F.lit(1))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.columns == [*extra.columns, "mix_copy"]
    rows = out.collect()
    assert rows and all(r.doc_id is not None and r.doc_id < 900000 for r in rows)
    assert len({(r.doc_id, r.mix_copy) for r in rows}) == len(rows) and max(r.mix_copy for r in rows) <= 3


def test_empty(spark, docs, tmp_path):
    for t, d in (("documents", docs), ("labels", spark.read.parquet(f"{SF}/labels.parquet")), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        d.where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_this_subpackage():
    code = ("import sys; sys.modules['corpus_pipeline'] = None\nimport importlib.util as u, __spark_entry__ as e\n"
            "find = u.find_spec\nprint(any(k.startswith('op') and k[2].isdigit() for k in e.queries()))")
    root = os.path.dirname(importlib.import_module("corpus_pipeline").__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "False", done.stderr[-500:]


def test_language_stage_without_languages_and_with_unlikely_texts(spark, docs):
    """Only texts without a letter go, whether or not a language could be learned and however unlikely the language."""
    odd = spark.createDataFrame([(900001, "12 34 !?", "en", "s", 1), (900002, None, "en", "s", 1), (900003, "", "en", "s", 1), (900004, "1 \u03a9 2", "en", "s", 1),
                                 (900005, "zq xj vk wq zz", None, "s", 1), (900006, "\u6f22\u5b57", None, "s", 1)], docs.schema)
    some = docs.unionByName(odd)
    gone = {900001, 900002, 900003} | {r.doc_id for r in docs.collect() if not any(map(str.isalpha, r.text or ""))}
    want = {r.doc_id for r in some.collect()} - gone
    assert {r.doc_id for r in P.language_id(spark, some, SF).collect()} == want
    unknown = some.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in P.language_id(spark, unknown, SF).collect()} == want


def test_every_component_keeps_one_row(spark, docs):
    """Repeated ids with unlinked texts, and a component of null ids beside null-id copies of a document with an id."""
    word = lambda seed: " ".join(f"w{seed}x{i * i + seed}" for i in range(40))
    a, b, c, d = map(word, (1, 2, 3, 4))
    rows = [(1, a), (1, b), (2, c), (1, c + " "), (5, d), (5, d), (None, a), (None, a + "\n"), (None, word(5)), (None, word(5) + " "), (None, word(5))]
    odd = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], docs.schema)
    assert len(set(brute_fp(t) for _, t in rows)) == 5
    got = sorted(((r.doc_id, r.text.strip()) for r in P.near_duplicates(spark, odd, SF).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (1, c), (5, d), (None, word(5))], key=str)
