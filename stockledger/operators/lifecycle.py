"""Replay of the whole ledger into the signal log, without a UDF.

Per item, in (event_ts, event_id) order, with the balance taken after each event:

* CONSUME with balance <= reorder point and no OPEN signal  -> OPEN (new id)
* INTAKE  with balance >  reorder point and an OPEN signal  -> FULFILLED
* acknowledgement command while a signal is OPEN             -> ACKNOWLEDGED

Closed form: label qualifying rows O / F / A; a row emits iff
(O and the previous label is not O) or (F/A and the previous label is O).
A closing row takes id, quantity and trigger from the last OPEN row before it.
Balance, previous label and open row are three windows over the same cells and
order (see ``ordered``): they share one exchange and one sort of the ledger, and no
row is joined or kept aside.  For items split into cells, a cell acts on the
state before it (balance, previous label, open row) as one function:

* the balance moves by the sum of the cell's movements, which fixes its labels;
* the previous label becomes the cell's last label, if it has any;
* the open row becomes the start of the cell's last run of O.  A run that starts
  behind another label of the cell starts for certain; one at the cell's
  first label starts there only if the previous label is not O.

Composing these functions in order is two windows over one row per cell (``_carries``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.operators.ordered import CELL, before, cells_before, in_cell, join_on_keys, plus, stored, upto, with_cells


def numeric_id(c):
    """The id as a number when it is one, else NULL (like try_cast, but a regex
    guard first: a failed cast is far slower than the check)."""
    return F.when(c.rlike(r"^-?[0-9]{1,19}$"), c.try_cast("bigint"))


def _ledger(scans: DataFrame, acks: DataFrame | None) -> DataFrame:
    mv = scans.filter(F.col("event_type").isin("INTAKE", "CONSUME")).select(
        "item_id", "event_ts", "event_id", F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(-F.col("qty")).cast("bigint").alias("delta"))
    if acks is None:
        return mv
    ak = acks.select("item_id", "event_ts", "event_id", F.lit("ACK").alias("kind"),
                     F.lit(0).cast("bigint").alias("delta"))
    return mv.unionByName(ak)


def lifecycle_state(scans_before: DataFrame, signals_before: DataFrame, as_of) -> DataFrame:
    """Per-item state after a replay: stock, and the open signal's trigger and quantity.

    ``as_of`` (a Column or literal) is the instant the state holds for; a later
    replay continues from it with ``signal_lifecycle(..., initial=state)``.
    """
    from stockledger.operators.latest import latest_signals
    bal = scans_before.groupBy("item_id").agg(F.sum(
        F.when(F.col("event_type") == "INTAKE", F.col("qty")).when(F.col("event_type") == "CONSUME", -F.col("qty"))
        .otherwise(0)).cast("bigint").alias("balance"))
    opened = latest_signals(signals_before).filter(F.col("status") == "OPEN").select(
        "item_id", F.col("trigger_event_id").alias("open_event_id"), F.col("triggered_at_qty").alias("open_balance"))
    st = bal.join(opened, "item_id", "full")
    return st.select("item_id", F.coalesce(F.col("balance"), F.lit(0).cast("bigint")).alias("balance"),
                     "open_event_id", "open_balance",
                     (as_of if not isinstance(as_of, str) else F.lit(as_of)).cast("timestamp_ntz").alias("as_of_ts"))


KEYS, ORDER = ["item_id"], ["event_ts", "event_id"]


def _label(balance, reorder_point: int):
    """O, F or A; a seed is O when its item has an open signal, else a neutral closing label."""
    kind = F.col("kind")
    return (F.when((kind == "CONSUME") & (balance <= reorder_point), F.lit("O"))
            .when((kind == "INTAKE") & (balance > reorder_point), F.lit("F"))
            .when(kind == "ACK", F.lit("A"))
            .when(kind == "SEED", F.when(F.col("seed_open_event_id").isNotNull(), F.lit("O")).otherwise(F.lit("S"))))


def _opened(balance):
    """What an O row opens: its id and balance; a seed hands on the signal that was open."""
    seed = F.col("kind") == "SEED"
    return F.struct(F.when(seed, F.col("seed_open_event_id")).otherwise(F.col("event_id")).alias("id"),
                    F.when(seed, F.col("seed_open_balance")).otherwise(balance).alias("balance"))


def _carries(split: DataFrame, reorder_point: int) -> DataFrame:
    """State before each cell of the split items: ``c_balance``, ``c_prev`` (label) and ``c_opened``."""
    w_c, cell = cells_before(KEYS), [*KEYS, CELL]
    moved = split.groupBy(*cell).agg(F.sum("delta").alias("moved")) \
        .select(*cell, F.sum("moved").over(w_c).alias("c_balance"))
    w = in_cell(KEYS, ORDER)
    labelled = join_on_keys(split, moved, cell).withColumn("balance", plus(F.sum("delta").over(upto(w)), F.col("c_balance"))) \
        .withColumn("label", _label(F.col("balance"), reorder_point)).filter(F.col("label").isNotNull()) \
        .withColumn("prev", F.lag("label").over(w))
    at, is_open, first = F.struct(*ORDER), F.col("label") == "O", F.col("prev").isNull()
    runs = labelled.groupBy(*cell).agg(
        F.max_by("label", at).alias("last_label"),
        F.max_by(_opened(F.col("balance")), F.when(is_open & (F.col("prev") != "O"), at)).alias("certain"),
        F.max_by(_opened(F.col("balance")), F.when(is_open & first, at)).alias("at_first"))
    state = join_on_keys(moved, runs, cell, "left").withColumn("c_prev", F.last("last_label", ignorenulls=True).over(w_c))
    last_run = F.coalesce("certain", F.when(~F.col("c_prev").eqNullSafe("O"), F.col("at_first")))
    return stored(state.withColumn("run", last_run).select(
        *cell, "c_balance", "c_prev", F.last("run", ignorenulls=True).over(w_c).alias("c_opened")), "carry")


def signal_lifecycle(scans: DataFrame, acks: DataFrame | None = None, params: Params = DEFAULT,
                     *, initial: DataFrame | None = None) -> DataFrame:
    """All signal rows the service would have appended, in the signal-log schema.

    ``initial`` (from ``lifecycle_state``) continues an earlier replay: one seed
    row per item, ordered before the new events, carries its stock and open
    signal, so only the new events are replayed.
    """
    none = {"seed_open_event_id": F.lit(None).cast("string"), "seed_open_balance": F.lit(None).cast("bigint")}
    led = _ledger(scans, acks).withColumns(none)
    if initial is not None:
        led = led.unionByName(initial.select(
            "item_id", F.col("as_of_ts").alias("event_ts"), F.lit("").alias("event_id"), F.lit("SEED").alias("kind"),
            F.col("balance").alias("delta"), F.col("open_event_id").alias("seed_open_event_id"),
            F.col("open_balance").alias("seed_open_balance")))
    cells = with_cells(led, KEYS, ORDER, params.scan_cell_rows)
    rows, w = cells.rows, in_cell(KEYS, ORDER)
    balance, prev, opened = F.sum("delta").over(upto(w)), F.last("label", ignorenulls=True).over(before(w)), \
        F.last("head", ignorenulls=True).over(upto(w))
    if cells.split is not None:
        rows = join_on_keys(rows, _carries(cells.split, params.reorder_point), [*KEYS, CELL], "left")
        balance, prev, opened = plus(balance, F.col("c_balance")), F.coalesce(prev, F.col("c_prev")), F.coalesce(opened, F.col("c_opened"))
    labelled = rows.withColumn("balance", balance).withColumn("label", _label(F.col("balance"), params.reorder_point)) \
        .filter(F.col("label").isNotNull()).withColumn("prev", prev)
    was_open = F.col("prev").eqNullSafe("O")
    status = (F.when((F.col("label") == "O") & ~was_open, F.lit("OPEN"))
              .when((F.col("label") == "F") & was_open, F.lit("FULFILLED"))
              .when((F.col("label") == "A") & was_open, F.lit("ACKNOWLEDGED")))
    # emitted rows alternate OPEN, close, OPEN, ...: a closing row's signal is the last one opened
    emitted = labelled.withColumn("status", status).filter(F.col("status").isNotNull()) \
        .withColumn("head", F.when(F.col("status") == "OPEN", _opened(F.col("balance")))) \
        .withColumn("opened", opened).filter(F.col("kind") != "SEED") \
        .withColumns({"open_event_id": F.col("opened.id"), "open_balance": F.col("opened.balance")})
    return emitted.select(
        numeric_id(F.col("event_id")).alias("id"),
        F.md5(F.concat_ws("|", F.col("item_id"), F.col("open_event_id"))).alias("signal_id"),
        F.col("event_ts").alias("created_ts"),
        "item_id",
        F.col("open_balance").alias("triggered_at_qty"),
        F.lit(params.reorder_point).alias("reorder_point"),
        F.lit(params.reorder_qty).alias("reorder_qty"),
        F.when(F.col("status") == "ACKNOWLEDGED", F.col("open_event_id")).otherwise(F.col("event_id"))
        .alias("trigger_event_id"),
        "status",
    )


def signal_snapshot_audit(signals: DataFrame, scans: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """OPEN rows whose triggered_at_qty differs from the replayed stock at the trigger event."""
    from stockledger.operators.ledger import running_on_hand
    bal = running_on_hand(scans.filter(F.col("event_type").isin("INTAKE", "CONSUME")), params) \
        .select(F.col("event_id").alias("trigger_event_id"), F.col("on_hand_qty").alias("replayed_qty"))
    opens = signals.filter(F.col("status") == "OPEN")
    j = opens.join(bal, "trigger_event_id", "left")
    return j.filter(~F.col("replayed_qty").eqNullSafe(F.col("triggered_at_qty"))).select(
        "signal_id", "item_id", "trigger_event_id", "triggered_at_qty", "replayed_qty")
