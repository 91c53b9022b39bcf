"""Operator 5: language identification by a byte convolutional network.

A window of ``width`` bytes passes an embedding of its bytes, convolutions of several widths,
max pooling over the window and a softmax layer; all are learned in numpy on labelled text.
A whole text is cut into consecutive windows (the last one padded); its language has the
greatest mean log-probability, windows weighing by their bytes.

Learning: at most ``train_rows`` different (id, language) pairs (smallest hash of the id, scaled by the
language's size, so rare languages are not crowded out; of more than ``train_rows`` languages the
most frequent) with one text each (the least, if rows
repeat the id); a few windows of each reach the driver.  Scoring is done in Arrow batches without a shuffle.  For scoring, embedding and
convolution are folded into two tables over byte pairs, which gives the same sums with two
look-ups for each place.

Cases: null texts and texts without a letter are ``und`` with score 0; without any labelled
text all are ``und``.  Of languages with equal probability the first by name is taken.  An empty
table gives no rows; a very long text is scored window by window.  Null ids count as the empty text in the crc rule.  Repeated rows each
give a row.  Only the id, text and (for learning) language columns are read; others cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import crc_mod, read

UNKNOWN = "und"
FOLDS, HELD = 4, 2
KERNELS = (2, 3, 4)        # widths of the filters, in bytes


@dataclass(frozen=True)
class Config:
    width: int = 160
    dim: int = 8
    filters: int = 16           # of each width
    train_rows: int = 3000      # bound of the learning sample
    windows: int = 3            # windows taken of each learning text
    epochs: int = 6
    batch: int = 32
    rate: float = 0.1
    seed: int = 11
    group: int = 128            # windows scored at a time


@dataclass
class Model:
    cfg: Config
    langs: tuple[str, ...]
    emb: np.ndarray                  # 256 x dim
    kernels: list[np.ndarray]        # for each width k: (k * dim) x filters
    shift: np.ndarray                # filters of all widths
    out: np.ndarray                  # languages x filters of all widths
    bias: np.ndarray


def windows(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x (width + reach) bytes, bytes in use of each); zero bytes pad the end of each window."""
    n = max(1, -(-len(data) // width))
    flat = np.zeros(n * width, dtype=np.uint8)
    flat[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((n, width + max(KERNELS) - 1), dtype=np.uint8)
    out[:, :width] = flat.reshape(n, width)
    used = np.full(n, width)
    used[-1] = len(data) - (n - 1) * width
    return out, used


def init(langs: tuple[str, ...], cfg: Config) -> Model:
    rng = np.random.default_rng(cfg.seed)
    total = cfg.filters * len(KERNELS)
    return Model(cfg, langs, rng.normal(0, 0.5, (256, cfg.dim)),
                 [rng.normal(0, (2.0 / (k * cfg.dim)) ** 0.5, (k * cfg.dim, cfg.filters)) for k in KERNELS],
                 np.zeros(total), np.zeros((len(langs), total)), np.zeros(len(langs)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], cfg: Config = Config()) -> Model:
    """Mini-batch gradient descent with momentum; only each filter's greatest place gets a gradient."""
    m = init(langs, cfg)
    rng = np.random.default_rng(cfg.seed + 1)
    speed = [np.zeros_like(p) for p in (m.emb, *m.kernels, m.shift, m.out, m.bias)]
    steps, step = max(1, cfg.epochs * -(-len(x) // cfg.batch)), 0
    for _ in range(cfg.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), cfg.batch):
            pick = order[at:at + cfg.batch]
            grads = gradients(m, x[pick], y[pick])
            rate = cfg.rate * (1 - step / steps)
            step += 1
            for p, v, g in zip((m.emb, *m.kernels, m.shift, m.out, m.bias), speed, grads):
                norm = float(np.sqrt((g * g).sum()))
                v *= 0.9
                v -= rate * g * min(1.0, 5.0 / max(norm, 1e-9))
                p += v
    return m


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    cfg, n = m.cfg, len(x)
    e = m.emb[x]                                         # n x (width + reach) x dim
    pooled, best, patches = [], [], []
    for k, w in zip(KERNELS, m.kernels):
        cols = np.lib.stride_tricks.sliding_window_view(e, k, axis=1)[:, :cfg.width]      # n x width x dim x k
        cols = cols.transpose(0, 1, 3, 2).reshape(n, cfg.width, k * cfg.dim)
        act = cols @ w
        top = act.argmax(axis=1)
        best.append(top)
        patches.append(cols[np.arange(n)[:, None], top])                                  # n x filters x (k * dim)
        pooled.append(np.take_along_axis(act, top[:, None, :], axis=1)[:, 0])
    z = np.concatenate(pooled, axis=1) + m.shift
    h = np.maximum(z, 0)
    g = softmax(h @ m.out.T + m.bias)
    g[np.arange(n), y] -= 1
    g /= n
    gh = (g @ m.out) * (z > 0)
    g_emb = np.zeros_like(m.emb)
    g_kernels = []
    for i, (k, w) in enumerate(zip(KERNELS, m.kernels)):
        gz = gh[:, i * cfg.filters:(i + 1) * cfg.filters]                                 # n x filters
        g_kernels.append(np.einsum("nf,nfd->df", gz, patches[i]))
        back = (gz[:, :, None] * w.T[None]).reshape(-1, cfg.dim)                          # n*filters*k x dim
        place = best[i][:, :, None] + np.arange(k)
        np.add.at(g_emb, x[np.arange(n)[:, None, None], place].reshape(-1), back)
    return [g_emb, *g_kernels, gh.sum(axis=0), g.T @ h, g.sum(axis=0)]


class Scorer:
    """Language probabilities of whole texts by two look-ups for each place."""

    def __init__(self, m: Model):
        self.m = m
        d, f = m.cfg.dim, m.cfg.filters
        part = lambda w, j: m.emb @ w[j * d:(j + 1) * d]  # noqa: E731  what a byte at place j adds
        pair = lambda w, j: (part(w, j)[:, None] + part(w, j + 1)[None]).reshape(65536, f)
        k2, k3, k4 = m.kernels
        self.first = np.concatenate([pair(k2, 0), pair(k3, 0), pair(k4, 0)], axis=1).astype(np.float32)
        third = np.repeat(part(k3, 2), 256, axis=0)
        self.second = np.concatenate([third, pair(k4, 2)], axis=1).astype(np.float32)
        self.f = f

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.m.langs)))
        for at in range(0, len(x), self.m.cfg.group):
            part = x[at:at + self.m.cfg.group].astype(np.int32)
            pairs = (part[:, :-1] << 8) | part[:, 1:]                  # n x (width + 2)
            act = self.first[pairs[:, :-2]]                            # n x width x filters
            act[:, :, self.f:] += self.second[pairs[:, 2:]]
            h = np.maximum(act.max(axis=1) + self.m.shift, 0)
            z = h @ self.m.out.T + self.m.bias
            z -= z.max(axis=1, keepdims=True)
            out[at:at + self.m.cfg.group] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                group.append(i)
                size += len(t)
            if size >= 1 << 20 or i == len(texts) - 1:
                self._group(texts, group, langs, scores)
                group, size = [], 0
        return langs, scores

    def _group(self, texts, group, langs, scores) -> None:
        if not group or not self.m.langs:
            return
        cut = [windows(texts[i].encode(), self.m.cfg.width) for i in group]
        x, used = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
        starts = np.cumsum([0, *(len(c[0]) for c in cut[:-1])])
        lp = self.log_probabilities(x)
        weight = np.add.reduceat(used, starts)[:, None]
        mean = np.add.reduceat(lp * used[:, None], starts) / weight
        prob = np.add.reduceat(np.exp(lp) * used[:, None], starts) / weight
        best = mean.argmax(axis=1)
        for k, i in enumerate(group):
            langs[i], scores[i] = self.m.langs[best[k]], float(min(1.0, prob[k, best[k]]))


def training_windows(docs: DataFrame, *, usable: Column, id_col: str, text_col: str, lang_col: str,
                     cfg: Config) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """Windows of the bounded learning sample with their languages, in a fixed order."""
    named = docs.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    named = named.where("lang is not null and t is not null and k is not null").where(usable)
    ids = named.select("k", "lang").withColumn("h", F.xxhash64(F.col("k").cast("string")))
    # smallest (hash place * size of the language) first: equal shares for all languages
    # a language that is learned has a text in the sample, so no more than train_rows count: a proven bound
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.train_rows)
    place = (F.col("h").cast("double") / 2.0 ** 64 + 0.5) * F.col("n")
    # repeated ids count once, so they do not crowd other texts out of the limit
    pick = (ids.join(F.broadcast(sizes), "lang").withColumn("p", place).select("p", "h", "k", "lang").distinct()
            .orderBy("p", "h", "k", "lang").limit(cfg.train_rows).select("k", "lang", "p"))
    # at most train_rows short rows: a proven bound for the broadcast; of rows that repeat an id
    # and language the least text is taken, so that no more than train_rows texts are cut into windows
    src = (named.join(F.broadcast(pick), ["k", "lang"]).groupBy("p", "k", "lang").agg(F.min("t").alias("t"))
           .select("p", F.col("k").cast("string").alias("k"), "lang", "t"))
    held = docs.sparkSession.sparkContext.broadcast(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            rows = []
            for p, k, lang, t in zip(*(col.to_pylist() for col in b.columns)):
                if any(map(str.isalpha, t)):
                    x, _ = windows(t.encode(), c.width)
                    rng = np.random.default_rng([len(x), int(p * 1e6) & 0xFFFFFFFF])
                    rows += [(p, k, lang, x[i].tobytes()) for i in sorted(rng.choice(len(x), min(c.windows, len(x)), replace=False).tolist())]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c_, t_) for c_, t_ in zip(
                cols, (pa.float64(), pa.string(), pa.string(), pa.binary()))], ["p", "k", "lang", "w"])

    got = src.mapInArrow(run, "p double, k string, lang string, w binary").toArrow().to_pylist()
    got = sorted((r["p"], r["k"], r["lang"], r["w"]) for r in got)
    langs = tuple(sorted({r[2] for r in got}))
    at = {name: i for i, name in enumerate(langs)}
    reach = cfg.width + max(KERNELS) - 1
    return (np.frombuffer(b"".join(r[3] for r in got), dtype=np.uint8).reshape(-1, reach),
            np.array([at[r[2]] for r in got], dtype=np.int64), langs)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          cfg: Config = Config()) -> Model:
    x, y, langs = training_windows(docs, usable=crc_mod(F.col("k"), FOLDS) != HELD, id_col=id_col, text_col=text_col,
                                   lang_col=lang_col, cfg=cfg)
    return fit(x, y, langs, cfg)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                langs, scores = scorer.classify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 ["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
