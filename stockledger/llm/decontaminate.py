"""Operator 9: benchmark decontamination.

Method: a broadcast hash set of normalised test n-grams; every task scans the word windows
of whole training texts against it, verifies each hash hit word by word, and the caller
removes the hit spans or the whole documents.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII code points.  A window
is ``n`` consecutive words of an item; an item of 1..n-1 words is one window of its own
length.  A document word inside any occurrence of any window is hit.

The set is flat arrays built once in the driver: the normalised words, sorted window hashes and
the items behind each window, under eight times the bytes of its text.  A benchmark of more than
``shard_bytes`` is cut in Spark into pieces (an item longer than a piece overlaps itself by
``n - 1`` words) and shards of at most that size, stored; one shard at a time is fetched,
broadcast, searched for in all documents and given up again, and the passes' spans are merged
per document.  One shard (the usual case) needs no shuffle, no storage and no job of its own
beyond the benchmark's size and rows.

Cases: null or wordless text: no words, nothing hit.  Null / wordless items have no
windows.  A null item id is reported as an empty string.  Repeated item ids count once.
Repeated document rows each give a row.  Empty tables give empty (or all-clean) results.
Texts are searched whole, whatever their length, one at a time, hashed a megabyte at a time.
Columns other than the id and text are not read by ``scan`` and kept as they are by
``remove_spans`` and ``drop_documents``; clashing names there are harmless (added columns have fresh names).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import fresh, read, stored, table_bytes

WINDOW = 10
SHARD_BYTES = 8 << 20
_PIECE = 1 << 20                    # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15          # odd multiplier over the words of a window
_STEP = 0x9FB21C651E98DF25          # odd multiplier over the bytes of a word
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# word bytes of a lower-cased text: digits, a-z and every byte of a non-ASCII code point
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


# some more than a piece, which ends where its last word does
_UP, _DOWN = (_powers(x, _PIECE + 4096) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


class Words:
    """The words of a text: lower-cased UTF-8 ``data``, byte places (``start``, ``end``) and a 64-bit ``code`` each."""

    def __init__(self, text: bytes | str | None):
        raw = text.encode() if isinstance(text, str) else text or b""
        self.data = raw.translate(_LOWER)
        parts = [self._piece(a, b) for a, b in self._cuts()]
        self.start, self.end, self.code = (np.concatenate(c) for c in zip(*parts)) if parts else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]]

    def _cuts(self) -> Iterator[tuple[int, int]]:
        """Byte ranges of about ``_PIECE`` that cut no word."""
        view, at = np.frombuffer(self.data, dtype=np.uint8), 0
        while at < len(view):
            stop = at + _PIECE
            while stop < len(view) and _WORD[view[stop]] and _WORD[view[stop - 1]]:
                gaps = np.flatnonzero(~_WORD[view[stop:stop + _PIECE]])
                stop += int(gaps[0]) if len(gaps) else _PIECE
            yield at, min(stop, len(view))
            at = stop

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        view = np.frombuffer(self.data, dtype=np.uint8)[a:b]
        edge = np.flatnonzero(np.diff(_WORD[view], prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        up, down = (_UP, _DOWN) if len(view) <= len(_UP) else (
            _powers(_STEP, len(view)), _powers(pow(_STEP, -1, 1 << 64), len(view)))
        total = np.zeros(len(view) + 1, dtype=np.uint64)
        np.cumsum((view.astype(np.uint64) + np.uint64(1)) * up[:len(view)], out=total[1:])
        code = (total[end] - total[start]) * down[start]
        return start + a, end + a, code ^ (code >> np.uint64(29))


def window_codes(code: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each window of ``size`` words: a polynomial in their codes."""
    out = np.zeros(max(len(code) - size + 1, 0), dtype=np.uint64)
    for k in range(size if len(out) else 0):
        out = out * np.uint64(_BASE) + code[k:k + len(out)]
    return out ^ (out >> np.uint64(31))


class Windows:
    """All windows of one size: sorted ``code`` with a place of each, and the items that hold it.

    Windows of one code that differ are entries of their own, so an entry is one exact window.
    """

    def __init__(self, words: Words, size: int, place: np.ndarray, item: np.ndarray, code: np.ndarray):
        order = np.lexsort((item, code))
        code, place, item = code[order], place[order], item[order]
        entry = np.concatenate(([True], code[1:] != code[:-1]))
        rest, moved = np.flatnonzero(~entry), False
        kinds = np.zeros(len(code), dtype=np.int64)
        others: dict[int, list[list[bytes]]] = {}      # by head of the code: windows that differ from it
        heads = np.maximum.accumulate(np.where(entry, np.arange(len(code)), 0))
        for r, h in zip(rest.tolist(), heads[rest].tolist()):
            mine = self.text(words, int(place[r]), size)
            if mine != self.text(words, int(place[h]), size):
                known, moved = others.setdefault(h, []), True
                if mine not in known:
                    known.append(mine)
                kinds[r] = 1 + known.index(mine)
        if moved:
            order = np.lexsort((item, kinds, code))
            code, place, item, kinds = code[order], place[order], item[order], kinds[order]
            entry = np.concatenate(([True], (code[1:] != code[:-1]) | (kinds[1:] != kinds[:-1])))
        at = np.flatnonzero(entry)
        self.size, self.code, self.place, self.item = size, code[at], place[at].astype(np.int32), item.astype(np.int32)
        self.first = np.append(at, len(code)).astype(np.int32)
        bits = int(np.clip(len(at).bit_length() + 2, 8, 24))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.code * np.uint64(_STEP)) >> self.shift] = True

    @staticmethod
    def text(words: Words, at: int, size: int) -> list[bytes]:
        return [words.word(at + k) for k in range(size)]


class NgramSet:
    """Window codes of a benchmark shard, with the words behind each for verification."""

    def __init__(self, items: Iterable[tuple[str, bytes | str | None]], n: int = WINDOW):
        self.names: list[str] = []
        number: dict[str, int] = {}
        data, sizes, owners = [], [], []
        for name, text in items:
            w = Words(text)
            if not len(w):
                continue
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            data.append(w.data)
            sizes.append(len(w))
            owners.append(number[name])
        self.words = Words(b" ".join(data))
        count, owner = np.array(sizes, dtype=np.int64), np.array(owners, dtype=np.int64)
        base = np.cumsum(count) - count
        self.windows: list[Windows] = []
        for size in sorted({min(n, x) for x in sizes}):
            mine = np.flatnonzero(np.minimum(count, n) == size)
            many = count[mine] - size + 1
            place = np.repeat(base[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            self.windows.append(Windows(self.words, size, place, np.repeat(owner[mine], many),
                                        window_codes(self.words.code, size)[place]))
        # what verification needs is all that is kept: the words' places
        self.words.start, self.words.end = self.words.start.astype(np.int32), self.words.end.astype(np.int32)
        self.words.code = None

    def find(self, words: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans covered by windows, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for w in self.windows:
            codes = window_codes(words.code, w.size)
            at = np.flatnonzero(w.seen[(codes * np.uint64(_STEP)) >> w.shift])
            if not len(at):
                continue
            lo, hi = (np.searchsorted(w.code, codes[at], side) for side in ("left", "right"))
            hit: set[int] = set()
            for start, a, b in zip(*(x[hi > lo].tolist() for x in (at, lo, hi))):
                mine = Windows.text(words, start, w.size)
                for entry in range(a, b):
                    if mine == Windows.text(self.words, int(w.place[entry]), w.size):
                        spans.append((start, start + w.size))
                        hit.add(entry)
            for entry in hit:
                items.update(w.item[w.first[entry]:w.first[entry + 1]].tolist())
        return merge(spans), {self.names[i] for i in items}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(text: bytes | None, n: int, limit: int) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes that hold every window of ``n`` words, short texts whole."""
    if not text or len(text) <= limit:
        yield text or b""
        return
    w, a = Words(text), 0
    while a < len(w):
        b = int(np.searchsorted(w.end, w.start[a] + limit, "right"))
        b = min(max(b, a + n), len(w))
        yield w.data[w.start[a]:w.end[b - 1]]
        if b == len(w):
            return
        a = b - n + 1


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int, n: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in lists of at most ``shard_bytes`` of text each (a window at least), one at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    size = table_bytes(rows, "i", "t")
    if size <= shard_bytes:
        yield _fetch(rows)
        return
    limit = max(shard_bytes // 8, 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = 0
        rows: list[tuple[str, bytes, int]] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int32()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, ["i", "t", "shard"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                for piece in pieces(text.as_py(), n, limit):
                    more = 16 + len(name.encode()) + len(piece)
                    if held and held + more > shard_bytes:
                        if rows:
                            yield batch()
                        shard, held = shard + 1, 0
                    held += more
                    rows.append((name, piece, shard))
            if rows:
                yield batch()

    # few tasks, so that most shards are full; a task streams its rows
    dealt = rows.coalesce(max(1, size // (16 * shard_bytes))).mapInArrow(number, "i string, t binary, shard int")
    table = stored(dealt.withColumn("task", F.spark_partition_id()), "benchmark-shards")
    for key in table.select("task", "shard").distinct().orderBy("task", "shard").collect():
        yield _fetch(table.where((F.col("task") == key["task"]) & (F.col("shard") == key["shard"])).select("i", "t"))


def _fetch(rows: DataFrame) -> list[tuple[str, bytes]]:
    got = rows.toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


_SPANS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_ARROW = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
          ("items", pa.list_(pa.string()))]


def text_words(column: pa.Array) -> Iterator[Words]:
    for t in column:
        raw = t.as_buffer()
        yield Words(raw.to_pybytes() if raw is not None else None)


def each_shard(start: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, n: int, shard_bytes: int,
               step: Callable[[DataFrame, Callable[[], NgramSet]], DataFrame], name: str) -> DataFrame:
    """``step`` of ``start`` for each shard in turn; between two shards the rows are stored and the set given up."""
    out, held = start, None
    for items in shards(benchmark, item_col, item_text, shard_bytes, n):
        if held is not None:
            out = stored(out, name)
            held.destroy()
        held = start.sparkSession.sparkContext.broadcast(NgramSet(items, n))
        out = step(out, lambda held=held: held.value)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: id, n_words, hit word spans (merged, end exclusive), items."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def one_pass(frame: DataFrame, items: list[tuple[str, bytes]], every: bool) -> tuple[DataFrame, object]:
        held = spark.sparkContext.broadcast(NgramSet(items, n))
        kind = frame.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = held.value
            for b in batches:
                rows, keep = [], []
                for words in text_words(b.column(1)):
                    spans, found = grams.find(words)
                    keep.append(every or bool(spans))
                    if keep[-1]:
                        rows.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted(found)))
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), *(
                    pa.array(c, t) for c, (_, t) in zip(cols, _ARROW))], ["id", *(x for x, _ in _ARROW)])

        return frame.mapInArrow(run, f"id {kind}, {_SPANS}"), held

    found: list[DataFrame] = []
    parts = shards(benchmark, item_col, item_text, shard_bytes, n)
    items, after = next(parts, []), next(parts, None)
    if after is None:
        return one_pass(src, items, True)[0]
    # several shards: number the rows; the first pass gives a row for each, the others only what they hit
    numbered = stored(src.withColumn("id", F.struct("id", F.uuid(F.lit(42)).alias("row"))), "decontaminate")
    while items is not None:
        out, held = one_pass(numbered, items, not found)
        found.append(stored(out, "decontaminate-pass"))
        held.destroy()
        items, after = after, next(parts, None)
    both = reduce(DataFrame.unionByName, found)
    # a row has one list of spans at most for each shard
    grouped = both.groupBy("id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"),
                                     F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("s", F.array().cast("array<struct<start:long,end:long>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    return grouped.select(F.col("id.id").alias("id"), "n_words", joined.alias("spans"), "items")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", n: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents with every hit word (and the separators inside hit spans) cut out of the text.

    Every shard is searched in the original text; its spans travel with the row and the text is cut once.
    """
    at = docs.columns.index(text_col)
    start = docs.withColumn(fresh(docs.columns, "spans"), F.array().cast("array<struct<start:long,end:long>>"))

    def step(frame: DataFrame, grams_of: Callable[[], NgramSet]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = grams_of()
            for b in batches:
                spans = [merge([*((s["start"], s["end"]) for s in old.as_py()), *grams.find(words)[0]])
                         for words, old in zip(text_words(b.column(at)), b.columns[-1])]
                found = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], b.schema.types[-1])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], schema=b.schema)

        return frame.mapInArrow(run, start.schema)

    out = each_shard(start, benchmark, item_col, item_text, n, shard_bytes, step, "remove-spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_at(t.as_py(), [(s["start"], s["end"]) for s in spans.as_py()]) for t, spans in zip(b.column(at), b.columns[-1])]
            cols = list(b.columns)[:-1]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return out.mapInArrow(finish, docs.schema)


def cut(text: str | None, grams: NgramSet) -> str | None:
    return cut_at(text, grams.find(Words(text))[0])


def cut_at(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the merged ``spans``."""
    if not text or not spans:
        return text
    raw, words = text.encode(), Words(text)       # lower-cased byte by byte: places are the same
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last:words.start[s]])
        last = words.end[e - 1]
    return (b"".join(out) + raw[last:]).decode()


def drop_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", n: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The document rows without any hit word; all columns as they are, no shuffle."""
    at = docs.columns.index(text_col)

    def step(frame: DataFrame, grams_of: Callable[[], NgramSet]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = grams_of()
            for b in batches:
                yield b.filter(pa.array([not grams.find(words)[0] for words in text_words(b.column(at))], pa.bool_()))

        return frame.mapInArrow(run, docs.schema)

    return each_shard(docs, benchmark, item_col, item_text, n, shard_bytes, step, "drop-documents")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    out = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, i, p.k, item FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
pos AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
