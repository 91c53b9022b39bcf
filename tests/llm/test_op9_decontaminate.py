"""Benchmark decontamination against a brute-force search."""

import hashlib
import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockledger.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(n, len(iw))
        for i in range(len(iw) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == iw[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def inputs():
    rng = random.Random(3)
    vocab = ["a", "B", "c", "Dé", "e5", "漢", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(12)]
    items += [(12, None), (13, ""), (13, "--"), (None, "Q R s"), (0, items[0][1]), (5, "z z z z z z")]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "?!"), (63, "q-r-S!"), (63, "q-r-S!"), (None, "z Z z z z z z z z"), (65, "y " * 5000 + items[3][1])]
    return docs, items


def got(df):
    return sorted(((r.id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in df.collect()), key=str)


def test_equals_brute_force_in_one_and_many_shards(spark):
    docs, items = inputs()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_words", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items, 4)) for i, t in docs), key=str)
    assert got(D.scan(d, b, n=4)) == want
    assert got(D.scan(d, b, n=4, shard_bytes=120)) == want


def test_remove_spans_and_documents(spark):
    docs, items = inputs()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 120):
        cut = D.remove_spans(d, b, n=4, shard_bytes=size)
        assert cut.columns == d.columns and cut.count() == len(docs)
        kept = sorted(((r.doc_id, r.text) for r in D.drop_documents(d, b, n=4, shard_bytes=size).collect()), key=str)
        assert kept == sorted(((i, t) for i, t in docs if brute(t, items, 4)[1] == 0), key=str)
    assert D.cut("x, one two; three. Four five y", D.NgramSet([("1", "two three four")], 3)) == "x, one  five y"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.scan(none, items).count() == 0
    assert D.scan(some, items).first().spans == []
    assert D.drop_documents(some, items).count() == 1 and D.remove_spans(none, items).count() == 0


def test_hash_collisions_are_verified(monkeypatch):
    """With one code for every window, results are still those of a word-by-word search."""
    docs, items = inputs()
    docs, items = [x for x in docs if len(x[1] or "") < 1000], [("" if i is None else str(i), t) for i, t in items]
    monkeypatch.setattr(D, "window_codes", lambda code, size: np.zeros(max(len(code) - size + 1, 0), dtype=np.uint64))
    grams = D.NgramSet(items, 4)
    for _, t in docs:
        spans, found = grams.find(D.Words(t))
        assert (len(words(t)), sum(e - s for s, e in spans), sorted(found)) == brute(t, items, 4)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_any_piece_size(monkeypatch, piece):
    monkeypatch.setattr(D, "_PIECE", piece)
    codes = {}
    for t in [None, "", "A", " a", "Dé漢😀x y-Z", "a" * 9000 + " b", "x" * 30 + "," * 30 + "Y1", "\x7f\x00é", *(t for _, t in inputs()[0])]:
        if len(t or "") > 9100:
            continue
        w = D.Words(t)
        assert [w.word(i).decode() for i in range(len(w))] == words(t)
        for i, c in enumerate(w.code.tolist()):
            assert codes.setdefault(w.word(i), c) == c
    assert len(set(codes.values())) == len(codes)


def test_pieces_hold_every_window_once():
    text = " ".join(f"w{i}" for i in range(300)) + " " + "z" * 500 + " end"
    whole = D.Words(text)
    windows = [tuple(whole.word(i + k) for k in range(4)) for i in range(len(whole) - 3)]
    got = []
    for p in D.pieces(text.encode(), 4, 40):
        w = D.Words(p)
        got += [tuple(w.word(i + k) for k in range(4)) for i in range(len(w) - 3)]
    assert got == windows
    assert list(D.pieces(None, 4, 40)) == [b""] and list(D.pieces(b"a b", 4, 1)) == [b"a b"]


def test_an_item_longer_than_a_shard(spark):
    """Items of many shards: fetched one at a time, the same result as one shard."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(30)]
    long = " ".join(rng.choice(vocab) for _ in range(600))
    items = [("long", long), ("other", "v1 v2 v3 v4 v5"), ("short", "only here")]
    at = words(long)
    docs = [(i, " ".join(at[i * 37:i * 37 + 9])) for i in range(16)] + [(50, "it is Only-Here now"), (51, "v9"), (52, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(D.shards(b, "item_id", "text", 400, 5))) > 5
    assert got(D.scan(d, b, n=5, shard_bytes=400)) == sorted(((i, *brute(t, items, 5)) for i, t in docs), key=str)


def test_set_stays_near_its_text():
    """The broadcast arrays of a shard are a small multiple of its bytes."""
    rng = random.Random(1)
    items = [(str(i), " ".join(f"{rng.randrange(10 ** 5):x}" for _ in range(200))) for i in range(1000)]
    grams = D.NgramSet(items)
    held = len(pickle.dumps(grams, protocol=5))
    assert held < 8 * sum(len(t) for _, t in items)


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "l m n"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "M n"), (9, "l m n")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in D.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert rows[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and rows[1].n_items == 2 and rows[1].contaminated
    assert rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[2].contaminated


def test_removed_spans_do_not_depend_on_shards(spark):
    docs, items = inputs()
    docs += [(70, "a b c d e f"), (71, "x y a b c d z w")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__spans", F.lit(2))
    for some in (items, [(1, "a b c d"), (2, "c d e f")], [(1, "a b c d"), (2, "x y z w")]):
        grams = D.NgramSet([(str(i), t) for i, t in some], 4)
        want = sorted(((i, D.cut(t, grams)) for i, t in docs), key=str)
        b = spark.createDataFrame(some, "item_id long, text string").coalesce(1)
        for size in (1 << 20, 24):
            got = D.remove_spans(d, b, n=4, shard_bytes=size)
            assert got.columns == d.columns
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
