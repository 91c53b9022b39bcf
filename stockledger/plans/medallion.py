"""Bronze -> silver -> gold layers (B1, B2, D1, D3, D4, C1) and the refresh plan (A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.operators import latest, ledger
from stockledger.operators.quality import SCAN_RULES, SIGNAL_RULES, Expectations, expect_or_drop, expectation_metrics
from stockledger.sources.sinks import materialize, publish, register_layer


def silver_scan_events(bronze: DataFrame) -> DataFrame:
    """B1: the three scan rules, then event date and hour."""
    return (expect_or_drop(bronze, SCAN_RULES)
            .withColumn("event_date", F.to_date("event_ts"))
            .withColumn("event_hour", F.hour("event_ts")))


def silver_replenishment_signals(bronze: DataFrame) -> DataFrame:
    """B2: the status rule, signal date, shortfall below the reorder point."""
    return (expect_or_drop(bronze, SIGNAL_RULES)
            .withColumn("signal_date", F.to_date("created_ts"))
            .withColumn("qty_below_reorder", F.col("reorder_point") - F.col("triggered_at_qty")))


def gold_inventory_summary(silver: DataFrame) -> DataFrame:
    """Stock per item over the silver scan log."""
    return ledger.movement_summary(silver)


def gold_daily_activity(silver: DataFrame) -> DataFrame:
    """D3: per (date, type) counts, quantity and two exact distinct counts."""
    return silver.groupBy("event_date", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("qty").alias("total_qty"),
        F.count_distinct("item_id").alias("unique_items"),
        F.count_distinct("station_id").alias("unique_stations"),
    )


def gold_open_replenishment_signals(silver_signals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Latest row per signal -> OPEN only -> left join live stock."""
    open_now = latest.latest_signals(silver_signals).filter(F.col("status") == "OPEN")
    inv = inventory.select("item_id", "on_hand_qty")
    j = open_now.join(inv, "item_id", "left")
    return j.select(
        "signal_id", "item_id",
        F.col("triggered_at_qty").alias("qty_at_signal"),
        F.col("on_hand_qty").alias("current_on_hand"),
        "reorder_point", "reorder_qty", "created_ts", "signal_date",
        (F.col("on_hand_qty") > F.col("reorder_point")).alias("already_restocked"),
    )


def gold_replenishment_metrics(silver_signals: DataFrame) -> DataFrame:
    """Latest state per signal, then per status: count, distinct items, mean shortfall."""
    cur = latest.latest_signals(silver_signals)
    return cur.groupBy("status").agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.count_distinct("item_id").alias("unique_items"),
        F.avg("qty_below_reorder").alias("avg_qty_below_reorder"),
    )


# Dependency order of the refresh: name -> (builder, inputs)
LAYERS = {
    "silver_scan_events": (silver_scan_events, ["bronze_scan_events"]),
    "silver_replenishment_signals": (silver_replenishment_signals, ["bronze_replenishment_signals"]),
    "gold_inventory_summary": (gold_inventory_summary, ["silver_scan_events"]),
    "gold_daily_activity": (gold_daily_activity, ["silver_scan_events"]),
    "gold_open_replenishment_signals": (gold_open_replenishment_signals,
                                        ["silver_replenishment_signals", "gold_inventory_summary"]),
    "gold_replenishment_metrics": (gold_replenishment_metrics, ["silver_replenishment_signals"]),
}
# layers stored partitioned, so date-filtered reads prune whole folders
PARTITION_BY = {"silver_scan_events": ["event_date"]}
QUALITY = {"bronze_scan_events": "bronze", "bronze_replenishment_signals": "bronze",
           "silver_scan_events": "silver", "silver_replenishment_signals": "silver",
           "gold_inventory_summary": "gold", "gold_daily_activity": "gold",
           "gold_open_replenishment_signals": "gold", "gold_replenishment_metrics": "gold"}


COMMENTS = {"bronze_scan_events": "Scan log as delivered", "bronze_replenishment_signals": "Signal log as delivered",
            "silver_scan_events": "Scans that pass the quality rules, with day and hour",
            "silver_replenishment_signals": "Signal rows with a known status, with day and shortfall",
            "gold_inventory_summary": "Stock and totals per item", "gold_daily_activity": "Activity per day and kind of event",
            "gold_open_replenishment_signals": "Signals open now, with live stock",
            "gold_replenishment_metrics": "Signals per status"}


def build_layers(bronze_scans: DataFrame, bronze_signals: DataFrame) -> dict[str, DataFrame]:
    """All layers as lazy DataFrames, in dependency order."""
    out = {"bronze_scan_events": bronze_scans, "bronze_replenishment_signals": bronze_signals}
    for name, (fn, deps) in LAYERS.items():
        out[name] = fn(*[out[d] for d in deps])
    return out


# rules whose counts a refresh takes in the pass that writes the layer
RULES = {"silver_scan_events": SCAN_RULES, "silver_replenishment_signals": SIGNAL_RULES}
EXPECTATIONS = "layer string, expectation_name string, passed_records bigint, failed_records bigint"


def write_layer(spark: SparkSession, name: str, inputs: list[DataFrame], target: str,
                version: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """Build one layer from its inputs and write it: (path, (rule, passed, failed) of its rules).

    The rules are counted in the writing pass.  A task that ran twice may be counted twice, so the
    rows that passed are held against those written; if they differ, the counts come from a pass of their own.
    """
    fn, _ = LAYERS[name]
    seen = Expectations(RULES[name]) if name in RULES else None
    df = fn(seen.watch(inputs[0]), *inputs[1:]) if seen else fn(*inputs)
    path = materialize(df, target, name, QUALITY[name], PARTITION_BY.get(name), version)
    if seen is None:
        return path, []
    if seen.kept == spark.read.parquet(path).count():
        return path, seen.rows()
    return path, [tuple(r) for r in expectation_metrics(inputs[0], RULES[name]).collect()]


def refresh(spark: SparkSession, bronze_scans: DataFrame, bronze_signals: DataFrame, target: str,
            params: Params = DEFAULT, database: str | None = None) -> dict[str, str]:
    """A4: full-refresh write of every layer, in dependency order, published at once at the end.

    Each refresh writes folders of its own.  Only when all layers are there does one small file make
    them the current ones (``sinks.publish``), so a refresh that fails leaves the layers before it
    readable and complete.  The counts of the quality rules are written with them (``expectations``).

    With ``database`` each layer is also a catalog view of its published folder, with a comment
    and its tier as the property ``quality``; views are replaced after the publication, one by one.

    Each written layer is read back before its dependants are built, so the
    latest-state ranking and the stock aggregate run once per refresh, and the
    lineage of every later layer starts at a stored table.
    """
    version = uuid.uuid4().hex[:12]
    written: dict[str, str] = {}
    frames = {"bronze_scan_events": bronze_scans, "bronze_replenishment_signals": bronze_signals}
    for name in list(frames):
        written[name] = materialize(frames[name], target, name, QUALITY[name], version=version)
        frames[name] = spark.read.parquet(written[name])
    counts: list[tuple] = []
    for name, (_, deps) in LAYERS.items():
        written[name], rules = write_layer(spark, name, [frames[d] for d in deps], target, version)
        counts += [(name, *r) for r in rules]
        frames[name] = spark.read.parquet(written[name])
    expectations = materialize(spark.createDataFrame(counts, EXPECTATIONS).coalesce(1), target, "expectations", "metrics", version=version)
    publish(spark, target, [*((name, QUALITY[name], path) for name, path in written.items()), ("expectations", "metrics", expectations)])
    if database is not None:
        for name, path in written.items():
            register_layer(spark, database, name, path, QUALITY[name], COMMENTS[name])
    return written
