"""Small column helpers: stock flags and status (B6, B7), display name (B18), time (H3, H5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed dashboard thresholds of the stock badge
CRITICAL_THRESHOLD = 5
LOW_THRESHOLD = 15
CRITICAL_BELOW_REORDER = 10


def with_below_reorder_point(df: DataFrame, reorder_point: int = 10, qty_col: str = "on_hand_qty") -> DataFrame:
    """``on_hand_qty <= reorder_point``."""
    return df.withColumn("below_reorder_point", F.col(qty_col) <= reorder_point)


def stock_status(qty: Column, below: Column) -> Column:
    """Critical / low / ok badge."""
    return (F.when((qty <= CRITICAL_THRESHOLD) | (below & (qty <= CRITICAL_BELOW_REORDER)), F.lit("critical"))
            .when((qty <= LOW_THRESHOLD) | below, F.lit("low"))
            .otherwise(F.lit("ok")))


def with_stock_status(df: DataFrame, reorder_point: int = 10, qty_col: str = "on_hand_qty") -> DataFrame:
    q = F.col(qty_col)
    return df.withColumn("stock_status", stock_status(q, q <= reorder_point))


def actor_name(name: Column, email: Column) -> Column:
    """Name, else the e-mail's part before '@', else 'Unknown'."""
    return (F.when(F.coalesce(F.length(name), F.lit(0)) > 0, name)
            .when(F.coalesce(F.length(email), F.lit(0)) > 0, F.substring_index(email, "@", 1))
            .otherwise(F.lit("Unknown")))


def with_actor_name(df: DataFrame, name_col: str | None = None, email_col: str = "user_email") -> DataFrame:
    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    return df.withColumn("actor_name", actor_name(name, F.col(email_col)))


def epoch_us(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """H5: difference in seconds as a double (intervals do not compare across engines)."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1_000_000.0)
