"""Spliced token counts equal those of whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockledger.llm import tokens as T

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
SP = sentencepiece.SentencePieceProcessor(model_file=P.path(T.MODEL))
ALPHABET = ["a", "b", "the ", " ", "  ", "\n", "▁", "é", "漢", "😀", "<0x0A>", "</s>", "\t", ".", "\x00", "　", "ing"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=150), st.sampled_from([(8, 1), (20, 2), (50, 7)]))
def test_splicing_is_exact(parts, sizes):
    counter = COUNTERS[sizes]
    text = "".join(parts)
    assert counter.provable
    assert counter.counts([text]) == [len(SP.encode(text))]


COUNTERS = {s: T.PieceCounter(T.MODEL, *s) for s in ((8, 1), (20, 2), (50, 7))}


def test_no_boundary_widens_to_the_whole():
    for text in ("a" * 5000, "漢" * 3000, " " * 4000, "▁" * 999, "ab" * 2000 + " c"):
        assert COUNTERS[(20, 2)].spliced(text) == len(SP.encode(text))


def test_cases(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(30000))
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x"), (4, long), (5, "<s>hi</s>")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    want = sorted(((i, len((t or "").encode()), len(SP.encode(t or ""))) for i, t in rows), key=str)
    for chunk in (T.CHUNK, 1000):
        got = T.count_tokens(d, chunk=chunk, overlap=16)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert T.count_tokens(d.where("false")).count() == 0
