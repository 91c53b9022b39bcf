"""Corpus pipeline over ``documents``: language ID, quality, near-duplicates, decontamination, mixing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes each result as Parquet in
the shared checkpoint folder and hands the reread rows to the next stage.  All stages but the
last return the columns of their input.  Rows are kept or dropped by their own text, so a
stage needs no join back to its input where its operator works row by row.

Cases: each stage inherits those of its operator.  Rows with a null id pass the filters by
their text; in near-duplicates they go if their component has a document with an id, else one
row of the component stays.  Rows that repeat an id count as copies if their texts are linked:
every component keeps one row, whatever ids stand in other components.  Without a labelled
text in any language the first stage passes every text with a letter; without quality labels
the second keeps what its untrained score allows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockledger.llm import decontaminate, language, mixing, quality_model, simhash
from stockledger.llm.common import fresh, read, stored
from stockledger.llm.registry import ORACLE, QUERIES  # noqa: F401  (the driver contract reads them here)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents for which language ID names no language: those without a letter.

    The score does not decide: a softmax over the learned languages is high for many foreign and
    shuffled texts too (figures in the README), so any limit that rejects them drops clean documents
    first.  If no language can be learned (no labelled text), every text with a letter passes.
    """
    held = spark.sparkContext.broadcast(language.train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = language.Scorer(held.value)
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = part.column(at).to_pylist()
                if scorer.m.langs:
                    kept = [name != language.UNKNOWN for name in scorer.classify(texts)[0]]
                else:
                    kept = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below the quality threshold."""
    held = spark.sparkContext.broadcast(quality_model.train(docs, read(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = quality_model.positive_scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([score(t.as_py()) >= quality_model.THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every SimHash component: the first by id (null ids last), then by a hash of the text."""
    key, a, b, nth = (fresh(docs.columns, n) for n in ("key", "a", "b", "nth"))
    none = F.col("doc_id").isNull()
    # two hashes name a row's id and text together; equal rows of one name always share a component
    hashes = [F.xxhash64(none, "doc_id", "text"), F.xxhash64("text", "doc_id", none)]
    named = docs.withColumn(key, F.struct(none.alias("none"), F.col("doc_id").alias("doc_id"), hashes[0].alias("a"), hashes[1].alias("b")))
    first = simhash.near_duplicates(named, id_col=key).select(F.col("component.a").alias(a), F.col("component.b").alias(b)).distinct()
    kept = docs.withColumn(a, hashes[0]).withColumn(b, hashes[1]).join(stored(first, "near-duplicates"), [a, b])
    # copies of the first row with the same id and text are numbered
    same = Window.partitionBy(a, b).orderBy(a)
    return kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    return decontaminate.drop_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as its source's target asks; adds ``mix_copy``."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing_to_weights),
]

# Learned models, 64-bit XXH64 fingerprints and balanced rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = QUERIES | {"pipeline": run}
