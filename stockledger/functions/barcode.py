"""H1 / H2: barcode text <-> (item, quantity), with an error column instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed format of a scan code: ITEM=<item id>;QTY=<digits>, whole text after
# stripping surrounding white space.  Digits are ASCII only.
BARCODE_PATTERN = r"^ITEM=([^;]+);QTY=([0-9]+)$"
_STRIP = r"^\s+|\s+$"


def make_barcode(item: Column | str, qty: Column | str) -> Column:
    """H2: ``ITEM=<item>;QTY=<qty>``."""
    item = F.col(item) if isinstance(item, str) else item
    qty = F.col(qty) if isinstance(qty, str) else qty
    return F.concat(F.lit("ITEM="), item, F.lit(";QTY="), qty.cast("string"))


def parse_barcode_cols(raw: Column) -> tuple[Column, Column, Column]:
    """(item_id, qty, error) for a raw barcode column.

    error: NULL when valid, else ``bad_format`` / ``non_positive`` / ``overflow``.
    """
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), _STRIP, "")
    ok = s.rlike(BARCODE_PATTERN)
    item = F.regexp_extract(s, BARCODE_PATTERN, 1)
    digits = F.regexp_extract(s, BARCODE_PATTERN, 2)
    # cast only matched digits: a failed cast on every malformed row is slow
    as_int = F.when(ok, digits.try_cast("int"))
    err = (F.when(~ok, F.lit("bad_format"))
           .when(as_int.isNull(), F.lit("overflow"))
           .when(as_int <= 0, F.lit("non_positive")))
    return (F.when(err.isNull(), item), F.when(err.isNull(), as_int), err)


def parse_barcodes(df: DataFrame, raw_col: str = "barcode_raw") -> DataFrame:
    """H1: add parsed_item_id, parsed_qty and parse_error."""
    item, qty, err = parse_barcode_cols(F.col(raw_col))
    return df.withColumns({"parsed_item_id": item, "parsed_qty": qty, "parse_error": err})
