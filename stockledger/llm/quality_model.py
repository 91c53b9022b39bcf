"""Operator 3: quality classifier on supervised subword embeddings.

A text is the average of learned vectors of its features: every word, the character n-grams
of every word (with word edges marked), markers for repeated words and repeated three-word
runs, and its size class; all hashed into ``buckets`` rows.  A softmax layer turns the average
into class probabilities.  Vectors and softmax weights are learned together by stochastic
gradient descent in numpy, one text a step, with a falling rate.

Learning: at most ``train_rows`` different (id, label) pairs, those with the smallest hash of the id, with
one text each (the least, if rows repeat the id); their whole texts become sparse feature counts in the tasks (at most ``buckets`` entries each), and
only these reach the driver.  Scoring: the average and the softmax layer are linear before
the exponential, so each bucket's contribution to the class logits is computed once and a
text's score is a mean of look-ups; every whole text is scored in Arrow batches without a
shuffle.

Cases: null and blank texts have only the size feature and get a score from it.  Null ids
count as the empty text in the crc rule.  Null labels are not learned from; without any
label all scores are 0.5.  An empty table gives no rows.  Equal texts have equal scores.  Texts are
read whole, whatever their length.  Repeated rows each give a row.  Only the id and text columns (and
of the labels the id and label) are read; others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import crc_mod, read

THRESHOLD = 0.3
FOLDS, HELD = 5, 0


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 16
    dim: int = 16
    min_n: int = 3
    max_n: int = 4
    train_rows: int = 3000     # bound of the learning sample
    epochs: int = 8
    rate: float = 0.3
    decay: float = 1e-4        # pull of vectors towards zero
    seed: int = 7


_MULT = np.uint64(0x9E3779B97F4A7C15)     # odd multipliers of the hashes
_STEP = np.uint64(0x100000001B3)
_PIECE = 1 << 20                          # bytes of a text hashed at a time


class Features:
    """Hashed features of texts, whole arrays at a time."""

    def __init__(self, cfg: Config):
        self.cfg = cfg
        self.shift = np.uint64(64 - (cfg.buckets.bit_length() - 1))
        self.again, self.echo = (self.marker(i) for i in (100, 101))

    def bucket(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * _MULT
        return (((h ^ (h >> np.uint64(29))) * _MULT) >> self.shift).astype(np.int64)

    def marker(self, i: int) -> int:
        return int(self.bucket(np.array([i], dtype=np.uint64), 99)[0])

    def _piece(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Buckets of the words and their character n-grams; the words' own hashes."""
        line = np.frombuffer(b"<" + b"> <".join(words) + b"> ", dtype=np.uint8).astype(np.uint64)
        gap = line == 32
        ends = np.flatnonzero(gap)
        starts = np.concatenate(([0], ends[:-1] + 1))
        # polynomial over each word's bytes, from its start
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int((ends - starts).max()), _STEP, np.uint64))))
        inside = np.arange(len(line)) - np.repeat(starts, ends - starts + 1)
        whole = np.add.reduceat(np.where(gap, np.uint64(0), (line + np.uint64(1)) * powers[inside]), starts)
        out = [self.bucket(whole, 0)]
        blanks = np.concatenate(([0], np.cumsum(gap)))
        h = line.copy()
        for k in range(2, self.cfg.max_n + 1):
            h = h[:-1] * _STEP + line[k - 1:]
            if k >= self.cfg.min_n and len(h):
                out.append(self.bucket(h[blanks[k:] == blanks[:-k]], k))
        return out, whole

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """Arrays of buckets, one entry per occurrence; the last array holds the markers."""
        words = text.encode().split() if text else []
        own, at = [], 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (size < _PIECE or to == at):
                size += len(words[to]) + 3
                to += 1
            got, whole = self._piece(words[at:to])
            own.append(whole)
            yield from got
            at = to
        w = np.concatenate(own) if own else np.zeros(0, np.uint64)
        yield np.array(self.markers(w), dtype=np.int64)

    def markers(self, w: np.ndarray) -> list[int]:
        """The size class, words repeating the one before and words ending a three-word run seen before.

        Markers stand several times, so that they weigh in the average.
        """
        runs = w[:-2] * _MULT + w[1:-1] * _STEP + w[2:] if len(w) > 2 else w[:0]
        return ([self.marker(len(w).bit_length())] * (1 + len(w) // 10) + [self.echo] * (4 * int((w[1:] == w[:-1]).sum()))
                + [self.again] * (4 * (len(runs) - len(np.unique(runs)))))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights adding to 1) of one text."""
        total = np.zeros(self.cfg.buckets)
        for ids in self.pieces(text):
            total += np.bincount(ids, minlength=self.cfg.buckets)
        idx = np.flatnonzero(total)
        return idx, total[idx] / total.sum()


@dataclass(frozen=True)
class Model:
    cfg: Config
    logits: np.ndarray     # classes x buckets: what a bucket adds to the class logits
    bias: np.ndarray
    classes: tuple[int, ...]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Sample:
    """Sparse learning rows in flat arrays: row r has the entries starts[r] .. starts[r + 1] of ids and weights."""
    starts: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    labels: list[int]

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Sample:
        return Sample(np.cumsum([0, *(len(i) for i, _, _ in rows)]), np.concatenate([np.zeros(0, np.int32), *(i for i, _, _ in rows)]).astype(np.int32),
                      np.concatenate([np.zeros(0, np.float32), *(w for _, w, _ in rows)]).astype(np.float32), [y for _, _, y in rows])


def fit(sample: Sample, cfg: Config = Config()) -> Model:
    """Stochastic gradient descent, one row a step, rows shuffled in every epoch."""
    classes = tuple(sorted(set(sample.labels))) or (0, 1)
    target = [classes.index(y) for y in sample.labels]
    rng = np.random.default_rng(cfg.seed)
    emb = rng.uniform(-1, 1, (cfg.buckets, cfg.dim)) / cfg.dim
    out = np.zeros((len(classes), cfg.dim))
    bias = np.zeros(len(classes))
    # a feature of one row only would just memorise that row
    rare = np.bincount(sample.ids, minlength=cfg.buckets) < 2
    emb[rare] = 0.0
    steps, step = max(1, cfg.epochs * len(target)), 0
    for _ in range(cfg.epochs):
        for r in rng.permutation(len(target)):
            at = slice(sample.starts[r], sample.starts[r + 1])
            idx, w = sample.ids[at], sample.weights[at].astype(np.float64)
            w[rare[idx]] = 0.0
            rate = cfg.rate * (1 - step / steps)
            step += 1
            rows_e = emb[idx]
            x = w @ rows_e
            g = softmax(out @ x + bias)
            g[target[r]] -= 1.0
            gx = g @ out
            out -= rate * np.outer(g, x)
            bias -= 0.1 * rate * g
            if (size := float(w @ w)) > 0:
                # scaled by the weights' square sum: the average moves by rate * gx whatever the text's length
                emb[idx] = rows_e * (1 - rate * cfg.decay) - (rate * w / size)[:, None] * gx
    return Model(cfg, np.ascontiguousarray(out @ emb.T), bias, classes)


class Scorer:
    """Class probabilities of whole texts."""

    def __init__(self, model: Model):
        self.m, self.f = model, Features(model.cfg)

    def probabilities(self, text: str | None) -> np.ndarray:
        total, n = np.zeros(len(self.m.classes)), 0
        for ids in self.f.pieces(text):
            total += [column[ids].sum() for column in self.m.logits]
            n += len(ids)
        return softmax(total / n + self.m.bias)


def positive_scorer(model: Model, positive: int = 1) -> Callable[[str | None], float]:
    """A text's probability of class ``positive``; 0.5 when that class was never seen."""
    if positive not in model.classes:
        return lambda text: 0.5
    scorer, at = Scorer(model), model.classes.index(positive)
    return lambda text: float(scorer.probabilities(text)[at])


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str, usable: Column, id_col: str, text_col: str,
                  cfg: Config) -> Sample:
    """Sparse features of the bounded learning sample, in a fixed order."""
    spark = docs.sparkSession
    order = F.xxhash64(F.col("k").cast("string"))
    # repeated labels count once, so they do not crowd other texts out of the limit
    pick = (labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y")).where("y is not null and k is not null")
            .where(usable).distinct().withColumn("h", order).orderBy("h", "k", "y").limit(cfg.train_rows))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    # the sample has at most train_rows short rows: a proven bound for the broadcast; of rows that
    # repeat an id the least text is taken, so that no more than train_rows texts reach the driver
    # (the few texts would be one partition: their features are spread over tasks again)
    src = (texts.join(F.broadcast(pick), "k").groupBy("h", "k", "y").agg(F.min("t").alias("t")).repartition(32, "k")
           .select("h", F.col("k").cast("string").alias("k"), "y", "t"))
    held = spark.sparkContext.broadcast(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = [feats.counts(t.as_py()) for t in part.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())),
                     pa.array([w.astype(np.float32) for _, w in got], pa.list_(pa.float32()))], ["h", "k", "y", "i", "w"])

    got = src.mapInArrow(run, "h long, k string, y int, i array<int>, w array<float>").toArrow()
    order_ = got.select(["h", "k", "y"]).append_column("r", pa.array(np.arange(got.num_rows)))
    got = got.take(order_.sort_by([(c, "ascending") for c in ("h", "k", "y")]).column("r")).combine_chunks()
    if not got.num_rows:
        return Sample.of([])
    ids, weights = (got.column(c).combine_chunks() for c in ("i", "w"))
    return Sample(ids.offsets.to_numpy(), ids.values.to_numpy(), weights.values.to_numpy(), got.column("y").to_pylist())


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", positive: int = 1) -> DataFrame:
    """(id, score): probability of class ``positive`` for every row; 0.5 when that class was never seen."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    held = spark.sparkContext.broadcast(model)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = positive_scorer(held.value, positive)
        for b in batches:
            got = [score_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["id", "score"])

    return src.mapInArrow(run, f"id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          cfg: Config = Config()) -> Model:
    model = fit(training_rows(docs, labels, label=label, usable=crc_mod(F.col("k"), FOLDS) != HELD, id_col=id_col,
                              text_col=text_col, cfg=cfg), cfg)
    pa.default_memory_pool().release_unused()      # the sample's memory goes back before the next stage
    return model


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == HELD).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
