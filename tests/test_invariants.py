"""Invariants between operators on the sf0.01 tables."""

from pyspark.sql import functions as F

from stockledger.operators import audits, ledger, lifecycle, quality
from stockledger.plans import medallion as M
from stockledger.sources import bridge

SF = "/root/testdata/sf0.01"


def test_silver_plus_quarantine_is_bronze(spark):
    b = bridge.bridge_e(spark, SF)
    s = quality.expect_or_drop(b, quality.SCAN_RULES)
    q = quality.quarantine(b, quality.SCAN_RULES)
    assert s.count() + q.count() == b.count()
    assert s.join(q, "event_id", "inner").count() == 0


def test_last_running_balance_is_summary_stock(spark):
    s = M.silver_scan_events(bridge.bridge_e(spark, SF))
    run = ledger.running_on_hand(s)
    last = run.groupBy("item_id").agg(F.max_by("on_hand_qty", F.struct("event_ts", "event_id")).alias("last"))
    inv = M.gold_inventory_summary(s)
    diff = last.join(inv, "item_id", "full").filter(~F.col("last").eqNullSafe(F.col("on_hand_qty")))
    assert diff.count() == 0


def test_at_most_one_open_signal_per_item(spark):
    b = bridge.bridge_e(spark, SF)
    sig = lifecycle.signal_lifecycle(M.silver_scan_events(b), bridge.acks_from_scans(b))
    assert audits.multiple_open_items(sig).count() == 0
    assert audits.illegal_transitions(sig).count() == 0
