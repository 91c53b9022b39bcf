"""Ordered per-key scans that do not put one hot key into one task.

A running sum or a "last non-null so far" per key is a window
``partitionBy(key).orderBy(...)``; all rows of a key meet in one task.  Here
the rows of a key lie in cells (key, cell number).  A key of at most
``cell_rows`` rows is one cell, so its scan is exactly that window: one
exchange, no carry.  Only larger keys are split:

1. ``with_cells`` finds them by one pre-aggregated count and stores their rows,
   range-partitioned by (key, order) into as many parts as hold ``cell_rows``
   rows each; a part is a cell.  Spark's range partitioner samples the bounds,
   whatever the density of a key's times and however large it is; no other
   row is stored.
2. Each stored cell is summarised (one row per cell, partial aggregation); a
   window per key over these summaries gives every cell its carry, the state
   before its first row.  Carries are stored, one row per cell.
3. One window per (key, cell) over all rows gives the result from the carry --
   the only exchange of the other keys' rows.

The result equals the plain window.  Rows without a time come first, as NULL
does in ascending order, and are never dropped.  Several scans over the same
keys and order (see ``lifecycle``) share the cells, the exchange and the sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from stockledger.session import scratch_path

_U = Window.unboundedPreceding
CELL = "__cell"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating NULL = NULL, keeping the left key columns only.

    The right side's keys are renamed first, so joining a frame with an
    aggregate of itself is unambiguous.
    """
    ren = {c: f"__rk{i}" for i, c in enumerate(keys)}
    r = right.select(*[F.col(c).alias(ren[c]) if c in ren else F.col(c) for c in right.columns])
    cond = [left[c].eqNullSafe(r[ren[c]]) for c in keys]
    return left.join(r, on=cond, how=how).drop(*ren.values())


def micros(ts_col: str) -> Column:
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


@dataclass(frozen=True)
class Cells:
    """``rows``: all rows with their cell number; ``split``: the stored rows of the split keys, None without such a key."""
    rows: DataFrame
    split: DataFrame | None


def with_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell_rows: int) -> Cells:
    """Number the cells of ``df``: 0 for a whole key, 1 and up, in order, for the parts of split keys."""
    keys = list(keys)
    large = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > cell_rows), "large-keys")
    rows = large.agg(F.sum("__n").alias("n")).first()["n"]
    if not rows:
        return Cells(df.withColumn(CELL, F.lit(0)), None)
    names = large.select(*keys)
    # kept first: the range partitioner samples its input, which would derive all rows once more
    found = stored(join_on_keys(df, names, keys, "left_semi"), "large-key-rows")
    dealt = found.repartitionByRange(-(-rows // cell_rows), *keys, *order)
    split = stored(dealt.withColumn(CELL, F.spark_partition_id() + 1), "split-keys")
    whole = join_on_keys(df, names, keys, "left_anti").withColumn(CELL, F.lit(0))
    return Cells(whole.unionByName(split), split)


def in_cell(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CELL).orderBy(*order)


def cells_before(keys: Sequence[str]) -> WindowSpec:
    """Over one row per cell: the cells of the same key before this one."""
    return Window.partitionBy(*keys).orderBy(CELL).rowsBetween(_U, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(_U, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(_U, -1)


def plus(value: Column, carry: Column) -> Column:
    """A running sum and its carry; NULL as in the plain window only where both are."""
    return F.coalesce(value + carry, value, carry)


def ordered_scan(cells: Cells, keys: Sequence[str], order: Sequence[str], *,
                 sums: dict[str, Column] | None = None,
                 last_before: dict[str, Column] | None = None) -> DataFrame:
    """Add per-key running columns in ``order``.

    sums:        out -> expr; running sum including the current row.
    last_before: out -> expr; last non-null value strictly before the current row.
    """
    sums, last_before = sums or {}, last_before or {}
    w, cols = in_cell(keys, order), [c for c in cells.rows.columns if c != CELL]
    local = {o: F.sum(e).over(upto(w)) for o, e in sums.items()}
    local |= {o: F.last(e, ignorenulls=True).over(before(w)) for o, e in last_before.items()}
    if cells.split is None:
        return cells.rows.select(*cols, *[c.alias(o) for o, c in local.items()])

    summary = cells.split.groupBy(*keys, CELL).agg(
        *[F.sum(e).alias(o) for o, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), F.struct(*order))).alias(o) for o, e in last_before.items()])
    w_c = cells_before(keys)
    carry = stored(summary.select(*keys, CELL, *[F.sum(o).over(w_c).alias(f"__c_{o}") for o in sums],
                                  *[F.last(o, ignorenulls=True).over(w_c).alias(f"__c_{o}") for o in last_before]), "carry")
    total = {o: plus(local[o], F.col(f"__c_{o}")) for o in sums}
    total |= {o: F.coalesce(local[o], F.col(f"__c_{o}")) for o in last_before}
    return join_on_keys(cells.rows, carry, [*keys, CELL], "left").select(*cols, *[c.alias(o) for o, c in total.items()])
