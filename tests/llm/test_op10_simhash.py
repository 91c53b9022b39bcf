"""SimHash components against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stockledger.llm import simhash as S


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, radius=3):
    """fps: {index: fingerprint}; index -> smallest index reachable."""
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(fps)
    for i in keys:
        for j in keys:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in fps}


def test_fingerprint_cases():
    for t in (None, "", " \t\n", "a", "A b", "a b c", "a b c d", "É é", "x y z", "one two three " * 40, "w" * 100000, "\x0b\x1c a"):
        assert S.fingerprint(t) == brute_fp(t), t
    assert S.fingerprint("A B") == S.fingerprint("a  b") and S.fingerprint(None) == 0
    S._PIECE, kept = 7, S._PIECE
    assert S.fingerprint("a b c d e f g h i j k l m n") == brute_fp("a b c d e f g h i j k l m n")
    S._PIECE = kept


def inserted(values):
    """The tree as inserting one value after the other gives it: {value: {distance: child}}."""
    tree = {values[0]: {}}
    for v in values[1:]:
        at = values[0]
        while (d := (at ^ v).bit_count()) in tree[at]:
            at = tree[at][d]
        tree[at][d] = v
        tree[v] = {}
    return tree


def test_bk_tree_is_the_inserted_one_and_finds_what_a_scan_finds():
    rng = random.Random(1)
    for values in ([5], list({rng.getrandbits(12) for _ in range(400)}), clustered(rng, 300)):
        tree = S.BKTree(np.array(values, dtype=np.uint64))
        want = inserted(values)
        for i, v in enumerate(values):
            kids = tree.child[tree.start[i * tree.STRIDE]:tree.start[(i + 1) * tree.STRIDE]]
            assert [values[k] for k in kids] == [c for _, c in sorted(want[v].items())]
        queries = [rng.getrandbits(12) for _ in range(100)] + rng.sample(values, min(100, len(values)))
        q, node = tree.within(np.array(queries, dtype=np.uint64), 2)
        assert sorted(zip(q.tolist(), node.tolist())) == sorted((i, j) for i, a in enumerate(queries) for j, b in enumerate(values) if (a ^ b).bit_count() <= 2)


def test_a_search_leaves_out_most_of_a_tree():
    rng = random.Random(2)
    tree = S.BKTree(np.array([rng.getrandbits(64) for _ in range(S.PER_SHARD)], dtype=np.uint64))
    tree.within(tree.values, S.RADIUS)
    assert tree.visited < 0.6 * S.PER_SHARD ** 2


def test_masks_of_near_fingerprints_meet():
    """Whatever 3 bits differ, some table's key is the same, also after every refinement."""
    rng = random.Random(3)
    for distinct in (10**6, 10**8, 10**11):
        blocks, bits = S.shard_plan(distinct)
        short, whole, finer = S.masks(blocks, bits, 3)
        assert all(m.bit_count() == bits and m & w == m for m, w in zip(short, whole))
        for _ in range(300):
            diff = sum(1 << p for p in rng.sample(range(64), 3))
            meet = [t for t, m in enumerate(whole) if not diff & m]
            assert meet and all(not diff & short[t] for t in meet)
            assert all(any(not diff & m for m in finer[t]) for t in meet)


def clustered(rng, n):
    out = [rng.getrandbits(64) for _ in range(n // 4)] + [0, (1 << 64) - 1, 1 << 63]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


def test_links_connect_like_all_pairs(spark):
    fps = clustered(random.Random(5), 400)
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    want = brute_components(dict(enumerate(fps)))
    # one shard, many shards, shards dealt anew by more bits, and shards cut into chunks
    for distinct, nodes, per_shard in ((10, 4096, 1024), (400, 4096, 16), (10, 50, 1024), (400, 50, 100), (400, 2, 16), (1 << 22, 50, 16), (1 << 40, 3, 16)):
        roots = {r.fp: r.root for r in S.components(S.links(df, distinct=distinct, tree_nodes=nodes, per_shard=per_shard)).collect()}
        groups, names = {}, {}
        for i, x in enumerate(fps):
            groups.setdefault(want[i], set()).add(i)
            names.setdefault(roots.get(S.signed(x), S.signed(x)), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, names.values())), (distinct, nodes, per_shard)


def test_shard_plan_grows():
    assert [S.shard_plan(n) for n in (0, 1024, 1025, 10**5, 10**8, 10**12, 10**14)] == [(4, 0), (4, 0), (4, 1), (4, 7), (5, 17), (6, 30), (6, 32)]


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "a long, b long")
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_documents_with_odd_cases(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 8
    rows = [(5, base), (3, base.upper()), (9, base + "x"), (1, None), (2, ""), (4, " "), (7, "only here"), (7, "only here"),
            (None, "only here"), (None, "nobody else"), (8, "word " * 30000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(((r.id, r.fp & (1 << 64) - 1, r.component) for r in S.near_duplicates(d).collect()), key=str)
    comp = brute_components({i: brute_fp(t) for i, (_, t) in enumerate(rows)})
    want = []
    for i, (k, t) in enumerate(rows):
        ids = [rows[j][0] for j in comp if comp[j] == comp[i] and rows[j][0] is not None]
        want.append((k, brute_fp(t), min(ids, default=None)))
    assert got == sorted(want, key=str)
    assert S.near_duplicates(d.where("false")).count() == 0
