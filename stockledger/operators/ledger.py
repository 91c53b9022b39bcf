"""Stock from the movement log: running balance (E2), raw-table summaries (D2, B8, B9),
as-of stock (C11), recent activity (F1, C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.operators.ordered import ordered_scan, with_cells


def signed_qty(type_col: str = "event_type", qty_col: str = "qty"):
    """+qty for INTAKE, -qty for CONSUME, 0 otherwise."""
    t = F.col(type_col)
    return (F.when(t == "INTAKE", F.col(qty_col)).when(t == "CONSUME", -F.col(qty_col))
            .otherwise(F.lit(0)))


def running_on_hand(scans: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Stock of the item after each event, in (event_ts, event_id) order."""
    order = ["event_ts", "event_id"]
    return ordered_scan(with_cells(scans, ["item_id"], order, params.scan_cell_rows), ["item_id"], order,
                        sums={"on_hand_qty": signed_qty().cast("bigint")})


def movement_summary(scans: DataFrame) -> DataFrame:
    """Stock, events, units in and out and newest event per item (partial + final hash aggregate)."""
    units = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("qty")).otherwise(0))
    return scans.groupBy("item_id").agg(
        F.sum(signed_qty()).alias("on_hand_qty"), F.count(F.lit(1)).alias("total_events"), units("INTAKE").alias("total_intake"),
        units("CONSUME").alias("total_consumed"), F.max("event_ts").alias("last_activity"))


def _totals(scans: DataFrame) -> DataFrame:
    intake = F.coalesce(F.sum(F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(0)), F.lit(0))
    consume = F.coalesce(F.sum(F.when(F.col("event_type") == "CONSUME", F.col("qty")).otherwise(0)), F.lit(0))
    return scans.groupBy("item_id").agg(
        intake.alias("intake_total"), consume.alias("consume_total"),
        (intake - consume).alias("on_hand_qty"), F.max("event_ts").alias("last_activity_ts"))


def all_inventory(scans: DataFrame, limit: int | None = 100) -> DataFrame:
    """Raw-table stock per item; a page (``limit``) is the first items by id, the whole has no order."""
    out = _totals(scans)
    return out.orderBy("item_id").limit(limit) if limit is not None else out


def inventory_item(scans: DataFrame, item_id: str) -> DataFrame:
    """One item's totals; empty when the item is unknown (filter pushed to the scan)."""
    return _totals(scans.filter(F.col("item_id") == F.lit(item_id)))


def on_hand_qty(scans: DataFrame, item_id: str) -> DataFrame:
    """One row always -- the item's stock, 0 when unknown."""
    one = scans.filter(F.col("item_id") == F.lit(item_id))
    return one.agg(F.coalesce(F.sum(signed_qty()), F.lit(0)).cast("bigint").alias("on_hand_qty")) \
        .select(F.lit(item_id).alias("item_id"), "on_hand_qty")


def recent_events(scans: DataFrame, limit: int = 20) -> DataFrame:
    """newest events first (per-partition top-k, then a merge)."""
    return scans.orderBy(F.col("event_ts").desc(), F.col("event_id")).limit(limit)


def recent_activity(scans: DataFrame, limit: int = 20) -> DataFrame:
    """C4: last N events, each with the item's current stock -- one join instead of N lookups."""
    top = recent_events(scans, limit)
    stock = _totals(scans).select("item_id", "on_hand_qty")
    j = top.join(stock, "item_id", "left")
    return j.select("event_id", "event_ts", "event_type", "station_id", "item_id", "qty",
                    F.coalesce(F.col("on_hand_qty"), F.lit(0).cast("bigint")).alias("on_hand_qty"))


def inventory_as_of(scans: DataFrame, probes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """C11: stock of each (item_id, probe_ts) probe -- an as-of join.

    Probes are unioned into the ledger as zero movements ordered after the
    events of the same instant; the running sum at a probe row is the stock
    as of that time.  Same scan as E2, so a hot item is spread out.
    """
    ev = scans.select("item_id", "event_ts", F.lit(0).alias("__k"), F.col("event_id").alias("__id"),
                      signed_qty().cast("bigint").alias("__d"))
    pr = probes.select("item_id", F.col("probe_ts").alias("event_ts"), F.lit(1).alias("__k"),
                       F.lit(None).cast("string").alias("__id"), F.lit(0).cast("bigint").alias("__d"))
    u = ev.unionByName(pr)
    order = ["event_ts", "__k", "__id"]
    s = ordered_scan(with_cells(u, ["item_id"], order, params.scan_cell_rows), ["item_id"], order, sums={"on_hand_qty": F.col("__d")})
    return s.filter(F.col("__k") == 1).select("item_id", F.col("event_ts").alias("probe_ts"), "on_hand_qty") \
        .dropDuplicates(["item_id", "probe_ts"])


def inventory_snapshot_plus_tail(snapshot: DataFrame, scans_after: DataFrame) -> DataFrame:
    """Stock from a stored summary (D1 as of t) plus only the events after t.

    Re-aggregating all history at every read grows with the log; here only the
    tail is aggregated (partial + final hash aggregate) and merged with the
    snapshot by a full outer join on item -- one row per item on each side.
    """
    sums = ("on_hand_qty", "total_events", "total_intake", "total_consumed")
    tail = movement_summary(scans_after).select("item_id", *[F.col(c).alias(f"t_{c}") for c in (*sums, "last_activity")])
    j = snapshot.join(tail, "item_id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return j.select("item_id", *[(z(c) + z(f"t_{c}")).alias(c) for c in sums],
                    F.greatest(F.col("last_activity"), F.col("t_last_activity")).alias("last_activity"))
