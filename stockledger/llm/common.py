"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.session import scratch_path

# Words of the licence and decontamination contracts: ASCII letters and digits plus every
# non-ASCII code point (fixed pattern).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words found in a text that is not lower-cased yet.
ALNUM_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Words of the quality and mixing contracts: runs without ASCII white space (fixed pattern).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other alphabets stay as they are."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a function of a column).

    Without this the optimizer may inline a costly expression into a lambda, where it
    would be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with marks added until no column (in any case) is called so."""
    taken, out = {c.lower() for c in columns}, f"__{name}"
    while out in taken:
        out += "_"
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor makes Spark reread files, not redo the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame, *cols: str) -> int:
    """UTF-8 bytes of the named columns plus 16 for each row, from one aggregate row."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(16))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"])
