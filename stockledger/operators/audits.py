"""Integrity audits over the two logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.operators.latest import latest_signals, status_rank
from stockledger.operators.ordered import ordered_scan, with_cells


def orphan_signals(signals: DataFrame, scans: DataFrame) -> DataFrame:
    """Signal rows whose trigger_event_id is missing from the scan log (left anti join)."""
    ev = scans.select(F.col("event_id").alias("trigger_event_id"))
    return signals.filter(F.col("trigger_event_id").isNotNull()).join(ev, "trigger_event_id", "left_anti")


def signals_with_trigger_event(signals: DataFrame, scans: DataFrame) -> DataFrame:
    """Each signal row with its trigger's type, station and time (inner join on event id)."""
    ev = scans.select(F.col("event_id").alias("trigger_event_id"), F.col("event_type").alias("trigger_type"),
                      F.col("station_id").alias("trigger_station"), F.col("event_ts").alias("trigger_ts"))
    return signals.join(ev, "trigger_event_id", "inner")


def multiple_open_items(signals: DataFrame) -> DataFrame:
    """V4: items with more than one currently-OPEN signal."""
    cur = latest_signals(signals).filter(F.col("status") == "OPEN")
    return cur.groupBy("item_id").agg(F.count(F.lit(1)).alias("open_signals")) \
        .filter(F.col("open_signals") > 1)


# fixed allowed transitions of a signal's status
ALLOWED = {("OPEN", "ACKNOWLEDGED"), ("OPEN", "FULFILLED"), ("ACKNOWLEDGED", "FULFILLED")}


def illegal_transitions(signals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """V3: rows whose status does not follow from the previous row of the same signal.

    The previous status is an ordered scan keyed by signal id, so a signal
    with a very long history is not ranked in one task.
    """
    s = signals.withColumn("__rk", status_rank()).withColumn("__idk", F.coalesce(F.col("id"), F.lit(-1)))
    order = ["created_ts", "__idk", "__rk"]
    p = ordered_scan(with_cells(s, ["signal_id"], order, params.scan_cell_rows), ["signal_id"], order, last_before={"prev_status": F.col("status")})
    ok = F.lit(False)
    for a, b in sorted(ALLOWED):
        ok = ok | ((F.col("prev_status") == a) & (F.col("status") == b))
    first_ok = F.col("prev_status").isNull() & (F.col("status") == "OPEN")
    return p.filter(~(ok | first_ok)).select("id", "signal_id", "created_ts", "item_id", "prev_status", "status")
