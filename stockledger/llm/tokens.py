"""Operator 2: token counts with overlap resynchronisation.

Texts are encoded whole by the tokenizer library inside Arrow batches.  A huge text (over
``chunk`` characters) is encoded in overlapping chunks with offsets.  Two neighbouring chunks
are spliced at a common boundary: a place in their overlap where both start a token and where
the vocabulary proves that no token can cross.  The proof: when no piece of the vocabulary has
the blank mark after another character, no merge can join a character with a blank that
follows it, so both sides of "character | blank" are encoded independently.  If an overlap
has no such place it is widened, at last to both chunks as one.  The count therefore equals
that of the whole text, while the encoder only holds one or two chunks.

A model whose vocabulary or normaliser does not allow the proof is used on whole texts only.

Cases: null counts as the empty text (0 bytes, 0 tokens).  Repeated rows each give a row; an
empty table gives no rows.  Only the id and text columns are read; others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import read

MODEL = "piece_bpe_32k.model"
CHUNK = 32768
OVERLAP = 512
LIMIT = 4096
_GROUP = 1 << 19          # characters encoded in one library call
_BLANK = "▁"


class PieceCounter:
    """Token counts of one sentencepiece model, loaded once per task."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import public_tokenizers
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        splits = all(_BLANK not in p.lstrip(_BLANK) for p in pieces)
        # identity normaliser with a leading blank: the text's pieces are the text itself
        probe = "  a Äﬁ  b "
        plain = "".join(self.sp.encode(probe, out_type=str))
        back = self.sp.decode(self.sp.encode(probe))
        self.provable = splits and plain.startswith(_BLANK * 3) and back == probe

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > self.chunk and self.provable:
                out[i] = self.spliced(t)
                continue
            group.append(i)
            size += len(t)
            if size >= _GROUP:
                self._encode(texts, group, out)
                group, size = [], 0
        self._encode(texts, group, out)
        return out

    def _encode(self, texts: list[str], group: list[int], out: list[int]) -> None:
        if group:
            for i, ids in zip(group, self.sp.encode([texts[i] for i in group], return_type="numpy", num_threads=1)):
                out[i] = len(ids)

    def starts(self, text: str, a: int, b: int) -> np.ndarray:
        """Where the tokens of text[a:b] start; the first blank is left to the encoder's own leading blank."""
        skip = 1 if a > 0 and text[a] in (" ", _BLANK) else 0
        part = text[a + skip:b]
        begins = np.array([p.begin for p in self.sp.encode(part, return_type="proto").pieces], dtype=np.int64)
        # the library's offsets are bytes; a character starts at every byte that is no continuation
        heads = np.cumsum((np.frombuffer(part.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
        at = heads[begins] + (a + skip)
        if len(at):
            at[0] = a
        return at

    def spliced(self, text: str) -> int:
        n, total, pos = len(text), 0, 0
        end = min(n, self.chunk)
        left = self.starts(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = end - overlap
                if begin <= pos:          # widened over the whole left chunk: both become one
                    end = min(n, pos + 2 * (end - pos))
                    left = self.starts(text, pos, end)
                    break
                stop = min(n, begin + max(self.chunk, 2 * overlap))
                right = self.starts(text, begin, stop)
                cut = self.boundary(text, left, right, begin, end)
                if cut is not None:
                    total += int(np.searchsorted(left, cut) - np.searchsorted(left, pos))
                    left, pos, end = right, cut, stop
                    break
                overlap *= 2
        return total + len(left) - int(np.searchsorted(left, pos))

    @staticmethod
    def boundary(text: str, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
        """The first place strictly inside the overlap where both start a token and no token can cross."""
        for p in np.intersect1d(left, right).tolist():
            if begin < p < end and text[p] in (" ", _BLANK) and text[p - 1] not in (" ", _BLANK):
                return p
        return None


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model, chunk, overlap)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counter.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds the context limit."""
    out = count_tokens(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
