"""Operator 10: SimHash near-duplicates linked through BK-trees.

1. ``fingerprints``: per text, XXH64 (seed 42) of every shingle of ``k`` words, majority vote
   per bit, in Arrow batches; no shuffle.
2. Equal fingerprints are grouped (pre-aggregated before the shuffle), so all further work
   is on distinct fingerprints and a group of copies of any size is one of them.
3. ``links``: shards.  Two fingerprints within ``radius`` bits differ in at most ``radius`` of
   ``b`` blocks, so they agree on ``b - radius`` blocks at least; a fingerprint is sent once
   for every choice of ``b - radius`` blocks, with some bits of these as the shard's key.  No
   link can be missed for any number of key bits; it is chosen so that a shard of evenly spread
   fingerprints holds about ``per_shard`` of them (512 to 1,024), with 4, 5 or 6 blocks.  Shards over
   ``tree_nodes`` fingerprints are dealt anew by all bits of their blocks, then by one more
   of the blocks that the remaining bits are cut into (again no link can be missed); what still
   agrees on all of that is cut into chunks, and every pair of chunks is a task of its own: one
   chunk's tree is sent to the other chunk's fingerprints, so neither a tree nor its queries
   outgrow a bound, and nothing is left out.
   Trees travel by shuffle to the tasks of their shard; a driver broadcast would need all
   fingerprints on the driver.
4. In each task a BK-tree (children keyed by the integer Hamming distance to the parent, in flat
   arrays) is built and searched along the edges ``d - radius .. d + radius``, many fingerprints
   together.  Only links from each fingerprint to the first of its part leave a task, at most one
   less than its fingerprints: the pairs of a dense group are not emitted.
5. ``components``: smallest-label propagation with pointer jumping over the kept links,
   each round stored in the checkpoint folder.

Cases: null, empty and blank texts have fingerprint zero and link like any other; a null
id is never the smallest unless all ids are null (then the component id is null); repeated rows each give a row; an empty
table gives no rows; of a very long text 65,536 shingles are counted at a time.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import read, stored

SHINGLE = 3
RADIUS = 3
BITS = 64
TREE_NODES = 4096   # nodes of a tree at most
PER_SHARD = 1024    # nodes of a tree aimed at
QUERIES = 128       # fingerprints that go down a tree together
SEED = 42          # fixed by the contract
_PIECE = 65536     # shingles counted at a time


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of the k-word shingles of a text, repeats counted; 0 without words."""
    words = text.encode().lower().split() if text else []   # bytes: only ASCII case and white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(k, len(words))
    start = [0, *(ends[:len(words) - size] + 1).tolist()]
    stop = ends[size - 1:].tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), _PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[at:at + _PIECE], stop[at:at + _PIECE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(start)).tolist())


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a signed long, for every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), k)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return src.mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """A tree over distinct integers whose children are keyed by the Hamming distance to the parent, in flat arrays.

    It is the tree that inserting ``values`` in turn would give.  All children of a node lie together,
    ordered by their key; ``start[node * STRIDE + d]`` is where those with key ``d`` begin.
    """

    STRIDE = BITS + 2

    def __init__(self, values: np.ndarray):
        self.values, n = values, len(values)
        code = np.zeros(n, dtype=np.int64)             # parent * STRIDE + key of every node but the root
        todo, group = np.arange(n), np.zeros(n, dtype=np.int64)
        while len(todo):
            # the first of every group is its subtree's root; the others are dealt by their distance to it
            first = np.ones(len(todo), dtype=bool)
            first[1:] = group[1:] != group[:-1]
            heads = todo[first]
            code[heads] = group[first]
            below, over = todo[~first], heads[(np.cumsum(first) - 1)[~first]]
            group = over * self.STRIDE + np.bitwise_count(values[below] ^ values[over])
            order = np.argsort(group, kind="stable")
            todo, group = below[order], group[order]
        self.child = (np.argsort(code[1:], kind="stable") + 1).astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(code[1:], minlength=n * self.STRIDE)))).astype(np.int32)
        self.visited = 0

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs at most ``radius`` apart.

        All queries go down together, a level at a time, along the edges ``d - radius .. d + radius`` only.
        """
        q, node = np.arange(len(queries), dtype=np.int32), np.zeros(len(queries), dtype=np.int32)
        found = []
        while len(q):
            self.visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            at = node.astype(np.int64) * self.STRIDE
            low, high = self.start[at + np.maximum(d - radius, 0)], self.start[at + np.minimum(d + radius + 1, self.STRIDE)]
            n = high - low
            step = np.repeat(np.arange(len(q)), n)
            q, node = q[step], self.child[np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n) + low[step]]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, node)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member of each part) after joining a[i] with b[i]."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def shard_links(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): every value with the least place of its part, where parts are connected by pairs within ``radius``.

    Pairs are those between ``queries`` and ``tree``, or within ``tree`` without queries.
    """
    both = tree if queries is None else np.concatenate((tree, queries))
    offset = 0 if queries is None else len(tree)
    label = np.arange(len(both))
    bk, asks = BKTree(tree), tree if queries is None else queries
    for at in range(0, len(asks), QUERIES):
        q, node = bk.within(asks[at:at + QUERIES], radius)
        label = merge(label, q + (at + offset), node)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[label[moved]], both[moved]


def shard_plan(distinct: int, radius: int = RADIUS, per_shard: int = PER_SHARD) -> tuple[int, int]:
    """(blocks, key bits): key bits so that shards of evenly spread fingerprints hold about ``per_shard``; two more blocks at most."""
    bits = max(0, math.ceil(math.log2(max(1, distinct) / per_shard)))
    for b in range(radius + 1, radius + 4):
        have = BITS * (b - radius) // b
        if bits <= have or b == radius + 3:
            return b, min(bits, have)


def cuts(places: list[int], parts: int) -> list[list[int]]:
    """Bit places cut into so many blocks."""
    return [places[len(places) * i // parts:len(places) * (i + 1) // parts] for i in range(parts)]


def masks(blocks: int, bits: int, radius: int) -> tuple[list[int], list[int], list[list[int]]]:
    """For each choice of blocks that two near fingerprints may share: the shard's key bits, all bits of
    the choice, and these with one of ``radius + 1`` blocks of the remaining bits."""
    short, whole, finer = [], [], []
    bit = lambda places: sum(1 << p for p in places)
    for keep in combinations(cuts(list(range(BITS)), blocks), blocks - radius):
        places = [p for block in keep for p in block]
        # evenly from all blocks of the choice
        short.append(bit([p for i in range(max(map(len, keep))) for block in keep for p in block[i:i + 1]][:bits]))
        whole.append(bit(places))
        left = [p for p in range(BITS) if p not in places]
        finer.append([bit(places) | bit(block) for block in cuts(left, radius + 1)])
    return (short[:1] if not bits else short), whole, finer


def dealt_by(rows: DataFrame, keys: list[list[int]], tables: bool) -> DataFrame:
    """(t, key, fp): ``keys[t]`` are the masks under which a fingerprint of table t is dealt; without ``tables`` all are used for every one."""
    one = lambda t, u, mask: F.struct(F.lit(t * 16 + u).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key"))
    lists = [F.array(*[one(t, u, m) for u, m in enumerate(row)]) for t, row in enumerate(keys)]
    if not tables:
        return rows.select("fp", F.inline(F.concat(*lists)))
    pick = F.lit(None)
    for t, row in enumerate(lists):
        pick = F.when(F.col("table") == t, row).otherwise(pick)
    return rows.select("fp", F.inline(pick))


def links(fps: DataFrame, *, distinct: int, radius: int = RADIUS, tree_nodes: int = TREE_NODES, per_shard: int = PER_SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within ``radius`` bits."""
    blocks, bits = shard_plan(distinct, radius, per_shard)
    short, whole, finer = masks(blocks, bits, radius)
    level, parts = dealt_by(fps, [[m] for m in short], False), []
    # shards over the bound are dealt anew by more bits: all bits of their blocks, then one more block each
    for finer_keys in ([[m] for m in whole], finer, None):
        large = stored(level.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_nodes), "large-shards")
        if large.isEmpty():
            parts.append(level.withColumns({"i": F.lit(0), "j": F.lit(0), "c": F.lit(0)}))
            break
        parts.append(level.join(large, ["t", "key"], "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0), "c": F.lit(0)}))
        hot = level.join(large, ["t", "key"])
        if finer_keys is not None:
            # with no key bits there was one table for all; with more, each goes on by its own blocks
            level = dealt_by(hot.withColumn("table", F.floor(F.col("t") / 16)), finer_keys, len(short) > 1 or finer_keys is finer)
            continue
        # shards that agree on all of this are cut into chunks; chunk c is the tree of the pairs (c, j >= c) and the queries of (i < c, c)
        chunks = F.ceil(F.col("n") / tree_nodes).cast("int")
        placed = hot.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp", "t"), "chunks").cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                            lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
        parts.append(placed.select("t", "key", "fp", "c", F.inline(pairs)).select("fp", "t", "key", "i", "j", "c"))
    # levels have table numbers of their own
    sent = reduce(DataFrame.unionByName, [p.withColumn("t", F.col("t") + 4096 * n) for n, p in enumerate(parts)])
    group = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            fp, side = (np.concatenate(x) for x in zip(*held))
            tree, queries = fp[side], fp[~side]
            if len(tree) + len(queries) > 1 and len(tree):
                yield pairs_batch(*shard_links(tree, queries if last[2] != last[3] else None, radius))

        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in (*group, "c", "fp")}
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = True
            for n in group:
                new[1:] |= cols[n][1:] != cols[n][:-1]
            ends = [*np.flatnonzero(new)[1:].tolist(), b.num_rows]
            for s, e in zip(np.flatnonzero(new).tolist(), ends):
                at = tuple(int(cols[n][s]) for n in group)
                if at != last:
                    if held:
                        yield from done()
                    last, held = at, []
                held.append((cols["fp"][s:e].astype(np.int64).view(np.uint64), cols["c"][s:e] == at[2]))
        if held:
            yield from done()

    return sent.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(run, "a long, b long").distinct()


def pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])


def components(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(fp, root): the smallest fingerprint that each linked fingerprint reaches.

    Every round takes the smallest label among a node's neighbours and itself, then the
    label of that label (pointer jumping), so long chains halve.  Raises if not done.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root"))
    labels = stored(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("fp").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "fp"), "fp").select("fp", "root", F.least("root", "m").alias("m"))
        jump = step.select(F.col("fp").alias("m"), F.col("m").alias("mm"))
        new = stored(step.join(jump, "m").select("fp", F.col("root").alias("old"), F.least("m", "mm").alias("root")), "labels")
        labels = new.select("fp", "root")
        if new.where("old <> root").isEmpty():
            return labels
    raise RuntimeError("link components did not settle")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``radius`` bits."""
    each = stored(fingerprints(docs, id_col=id_col, text_col=text_col, k=k), "fingerprints")
    known = stored(each.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(known.select("fp"), distinct=known.count(), radius=radius, tree_nodes=tree_nodes))
    linked = known.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # roots of linked fingerprints only; the others are their own component
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    return each.join(named, "fp").select("id", "fp", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))
