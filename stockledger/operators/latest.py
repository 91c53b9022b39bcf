"""Latest state per key on append-only logs (E1) and the signal read/write paths
built on it (B10, C2, C3, C7-C10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.config import ALERT_SUMMARY_FORMAT, DEFAULT, STATUS_RANK, Params

# fixed tie-break rank of statuses (later state wins on equal created_ts)
def status_rank():
    """STATUS_RANK as a column (unknown statuses rank lowest)."""
    rank = F.lit(0)
    for status, r in STATUS_RANK.items():
        rank = F.when(F.col("status") == status, F.lit(r)).otherwise(rank)
    return rank


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key: the row with the greatest ``order`` tuple.

    Written as ``max_by`` over a struct, which Spark aggregates partially on
    the map side, so a key with very many rows is reduced before the shuffle
    instead of being ranked whole in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def signal_order() -> list[Column]:
    """created_ts, then id (null lowest), then status rank."""
    return [F.col("created_ts"), F.col("id"), status_rank()]


def latest_signals(signals: DataFrame) -> DataFrame:
    """E1 on the signal log: current row of every signal_id."""
    return latest_by(signals, ["signal_id"], signal_order())


def live_stock_raw(scans: DataFrame) -> DataFrame:
    """Stock per item on the raw log: intake minus consume, other types ignored."""
    return scans.groupBy("item_id").agg(
        (F.coalesce(F.sum(F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(0)), F.lit(0))
         - F.coalesce(F.sum(F.when(F.col("event_type") == "CONSUME", F.col("qty")).otherwise(0)), F.lit(0)))
        .alias("on_hand_qty"))


def signals_by_status(signals: DataFrame, status: str | None = None) -> DataFrame:
    """Optional status filter applied after the latest-state selection."""
    cur = latest_signals(signals)
    return cur if status is None else cur.filter(F.col("status") == status)


def signals_with_live_stock(signals: DataFrame, scans: DataFrame, status: str | None = None,
                            limit: int = 50) -> DataFrame:
    """Latest raw rows (any status) with live stock, missing stock -> 0, newest first."""
    cur = signals_by_status(signals, status)
    inv = live_stock_raw(scans)
    j = cur.join(inv, "item_id", "left")
    out = j.select("signal_id", "created_ts", "item_id",
                   F.coalesce(F.col("on_hand_qty"), F.lit(0).cast("bigint")).alias("current_qty"),
                   "triggered_at_qty", "reorder_point", "reorder_qty", "status")
    return out.orderBy(F.col("created_ts").desc(), F.col("signal_id")).limit(limit)


def signals_dashboard_overlay(signals_page: DataFrame, inventory_page: DataFrame) -> DataFrame:
    """The dashboard's stock for items on the listed inventory page, else the signal's value.

    The inventory page may be any listing; Spark broadcasts it when it is small.
    """
    page = inventory_page.select("item_id", F.col("on_hand_qty").alias("page_qty"))
    j = signals_page.join(page, "item_id", "left")
    return j.select("signal_id", "item_id", "status", "current_qty",
                    F.coalesce(F.col("page_qty"), F.col("current_qty")).alias("display_qty"))


def new_signals(candidates: DataFrame, signals: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Signal rows to append for candidates whose item has no currently-OPEN signal.

    candidates: item_id, created_ts, triggered_at_qty, trigger_event_id.
    One candidate per item is kept (the earliest), then items with an open
    signal are removed with an anti join.
    """
    first = _earliest(candidates)
    open_items = latest_signals(signals).filter(F.col("status") == "OPEN").select("item_id")
    fresh = first.join(open_items, "item_id", "left_anti")
    return fresh.select(
        F.lit(None).cast("bigint").alias("id"),
        F.md5(F.concat_ws("|", F.col("item_id"), F.col("trigger_event_id"))).alias("signal_id"),
        "created_ts", "item_id",
        F.col("triggered_at_qty").cast("bigint").alias("triggered_at_qty"),
        F.lit(params.reorder_point).alias("reorder_point"),
        F.lit(params.reorder_qty).alias("reorder_qty"),
        "trigger_event_id", F.lit("OPEN").alias("status"))


def _earliest(candidates: DataFrame) -> DataFrame:
    """First candidate per item by (created_ts, trigger_event_id) ascending."""
    return (candidates.groupBy("item_id")
            .agg(F.min_by(F.struct("created_ts", "triggered_at_qty", "trigger_event_id"),
                          F.struct("created_ts", "trigger_event_id")).alias("__r"))
            .select("item_id", "__r.*"))


def acknowledge_signals(signals: DataFrame, commands: DataFrame, new_status: str = "ACKNOWLEDGED",
                        allowed_from: Sequence[str] | None = None) -> DataFrame:
    """Rows to append for status commands (signal_id, ts); unknown ids give no row.

    The new row copies quantity, points and trigger of the signal's latest row.
    ``allowed_from`` restricts the current statuses a command may change
    (default: any, as in the modelled application).
    """
    cur = latest_signals(signals)
    if allowed_from is not None:
        cur = cur.filter(F.col("status").isin(list(allowed_from)))
    j = cur.join(commands.select("signal_id", F.col("ts").alias("__ts")), "signal_id", "inner")
    return j.select(F.lit(None).cast("bigint").alias("id"), "signal_id", F.col("__ts").alias("created_ts"),
                    "item_id", "triggered_at_qty", "reorder_point", "reorder_qty", "trigger_event_id",
                    F.lit(new_status).alias("status"))


def fulfill_signals(signals: DataFrame, intakes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every OPEN signal of a restocked item gets a FULFILLED row.

    intakes: item_id, event_id, event_ts, on_hand_qty (stock after the intake).
    The first intake per item that lifts stock above the reorder point closes
    all of that item's open signals; the old triggered_at_qty is kept and the
    trigger becomes the intake event.
    """
    rp = params.reorder_point
    first = (intakes.filter(F.col("on_hand_qty") > rp).groupBy("item_id")
             .agg(F.min_by(F.struct("event_id", "event_ts"), F.struct("event_ts", "event_id")).alias("__e"))
             .select("item_id", F.col("__e.event_id").alias("__eid"), F.col("__e.event_ts").alias("__ets")))
    open_now = latest_signals(signals).filter(F.col("status") == "OPEN")
    j = open_now.join(first, "item_id", "inner")
    return j.select(F.lit(None).cast("bigint").alias("id"), "signal_id", F.col("__ets").alias("created_ts"),
                    "item_id", "triggered_at_qty", "reorder_point", "reorder_qty",
                    F.col("__eid").alias("trigger_event_id"), F.lit("FULFILLED").alias("status"))


def pct_items_with_open_signal(signals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Share of items (of the stock summary) that have a currently-OPEN signal."""
    open_items = (latest_signals(signals).filter(F.col("status") == "OPEN")
                  .select("item_id").distinct().withColumn("__open", F.lit(True)))
    j = inventory.select("item_id").join(open_items, "item_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total_items"),
                 F.count_if(F.col("__open")).alias("items_with_open_signal")).select(
        "total_items", "items_with_open_signal",
        F.round(F.try_divide(F.col("items_with_open_signal") * 100.0, F.col("total_items")), 4)
        .alias("pct_items_with_open_signal"))


def open_signal_alert(signals: DataFrame, threshold: int = 0) -> DataFrame:
    """One row -- open count on the raw log, whether it exceeds the threshold, summary text."""
    cur = latest_signals(signals)
    one = cur.agg(F.count_if(F.col("status") == "OPEN").alias("open_count"))
    return one.select(
        "open_count",
        (F.col("open_count") > threshold).alias("triggered"),
        F.format_string(ALERT_SUMMARY_FORMAT, F.col("open_count")).alias("summary"))
