"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the
inventory, run over whole test tables through the bridges (FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.functions import barcode, columns, slips
from stockledger.operators import analytics as A
from stockledger.operators import audits, debounce, ingest, latest, ledger, lifecycle, quality
from stockledger.plans import medallion as M
from stockledger.session import apply_conf, scratch_path
from stockledger.sources import bridge, sinks, slipdata, tables


class Ctx:
    """Lazily built inputs and layers for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = DEFAULT):
        apply_conf(spark)
        self.spark, self.sf_dir, self.p = spark, sf_dir, params

    def table(self, name: str) -> DataFrame:
        return bridge.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def bronze(self) -> DataFrame:
        return bridge.scans_from_events(self.table("events"))

    @cached_property
    def silver(self) -> DataFrame:
        return M.silver_scan_events(self.bronze)

    @cached_property
    def as_of(self):
        """The newest event time as a literal, for questions about a few days."""
        return A.newest_event(self.silver)

    @cached_property
    def risk(self) -> DataFrame:
        return A.stockout_risk(self.inventory, A.consumption_rate(self.silver, 7, self.as_of), 10)

    @cached_property
    def acks(self) -> DataFrame:
        return bridge.acks_from_scans(self.bronze)

    @cached_property
    def signals(self) -> DataFrame:
        """Bridge S: the replayed signal log (bronze signals)."""
        return lifecycle.signal_lifecycle(self.silver, self.acks, self.p)

    @cached_property
    def silver_signals(self) -> DataFrame:
        return M.silver_replenishment_signals(self.signals)

    @cached_property
    def inventory(self) -> DataFrame:
        return M.gold_inventory_summary(self.silver)

    @cached_property
    def daily(self) -> DataFrame:
        return M.gold_daily_activity(self.silver)

    @cached_property
    def gold_open(self) -> DataFrame:
        return M.gold_open_replenishment_signals(self.silver_signals, self.inventory)

    @cached_property
    def lineitem_scans(self) -> DataFrame:
        return bridge.scans_from_lineitem(self.table("lineitem"))

    @cached_property
    def rescans(self) -> DataFrame:
        return bridge.rescans(self.bronze)

    @cached_property
    def raw_scans(self) -> DataFrame:
        """Ingest input: bridge R in raw form; ERROR rows carry their ``props`` text
        instead of a code, so malformed input is exercised."""
        bronze = bridge.scans_from_events(self.table("events"), "props")
        return bridge.raw_scans_from_scans(bridge.rescans(bronze, "props"), "props").select("scan_id", "event_ts",
                        F.when(F.col("kind") == "ERROR", F.lit("CONSUME")).otherwise(F.col("kind")).alias("kind"),
                        "station_id",
                        F.when(F.col("kind") == "ERROR", F.col("props")).otherwise(F.col("barcode_raw"))
                        .alias("barcode_raw"),
                        "user_email")

    @cached_property
    def slip_parsed(self) -> DataFrame:
        return slips.parse_slip_responses(slipdata.slip_responses(self.spark, self.sf_dir))

    @cached_property
    def slip_lines(self) -> DataFrame:
        return slips.slip_lines(self.slip_parsed)

    @cached_property
    def running(self) -> DataFrame:
        return ledger.running_on_hand(self.silver, self.p)


def _q(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Ctx(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _signal_cols(df: DataFrame) -> DataFrame:
    return df.select("id", "signal_id", "created_ts", "item_id", "triggered_at_qty", "reorder_point",
                     "reorder_qty", "trigger_event_id", "status")


def _probes(c: Ctx) -> DataFrame:
    """C11 probes: every item at 15:00 of every day on which it moved."""
    return c.silver.select("item_id", (F.col("event_date").cast("timestamp_ntz")
                                       + F.make_dt_interval(hours=F.lit(15))).alias("probe_ts")).distinct()


def _c7(c: Ctx) -> DataFrame:
    """C7 candidates: items now at or below the point, triggered by their last CONSUME."""
    last_consume = (c.silver.filter(F.col("event_type") == "CONSUME").groupBy("item_id")
                    .agg(F.max_by(F.struct("event_id", "event_ts"), F.struct("event_ts", "event_id")).alias("e")))
    low = c.inventory.filter(F.col("on_hand_qty") <= c.p.reorder_point).select("item_id", "on_hand_qty")
    cand = low.join(last_consume, "item_id").select(
        "item_id", F.col("e.event_ts").alias("created_ts"), F.col("on_hand_qty").alias("triggered_at_qty"),
        F.col("e.event_id").alias("trigger_event_id"))
    # items whose last signal was acknowledged (no longer OPEN) get a new one
    return latest.new_signals(cand, c.signals, c.p)


def _half(c: Ctx):
    cut = c.silver.agg(F.expr("timestamp_millis(cast((min(unix_millis(cast(event_ts as timestamp))) "
                              "+ max(unix_millis(cast(event_ts as timestamp)))) / 2 as bigint))")
                       .cast("timestamp_ntz")).scalar()
    return cut


def _c8(c: Ctx) -> DataFrame:
    """C8 commands: acknowledge every signal that is OPEN now, at the last event time."""
    cur = latest.latest_signals(c.signals).filter(F.col("status") == "OPEN")
    cmd = cur.select("signal_id", A.as_of_col(c.silver).alias("ts"))
    return latest.acknowledge_signals(c.signals, cmd)


def _c9(c: Ctx) -> DataFrame:
    """Signals replayed on the first half of the ledger, fulfilled by second-half intakes."""
    cut = _half(c)
    first = lifecycle.signal_lifecycle(c.silver.filter(F.col("event_ts") < cut), None, c.p)
    intakes = c.running.filter((F.col("event_ts") >= cut) & (F.col("event_type") == "INTAKE")) \
        .select("item_id", "event_id", "event_ts", "on_hand_qty")
    return latest.fulfill_signals(first, intakes, c.p)


def _a4(c: Ctx) -> DataFrame:
    target = scratch_path(c.spark, "refresh")
    M.refresh(c.spark, c.bronze, c.signals, target, c.p)
    return c.spark.read.parquet(sinks.published(c.spark, target)["gold_inventory_summary"])


def _layers(c: Ctx) -> DataFrame:
    """A4: every written layer read back from the catalog: its tier, whether it has a comment, its rows."""
    target = scratch_path(c.spark, "layers")
    database = "stockledger_" + target.rsplit("-", 1)[-1]
    c.spark.sql(f"CREATE DATABASE {database}")
    M.refresh(c.spark, c.bronze, c.signals, target, c.p, database)
    parts = []
    for name in M.QUALITY:
        quality = c.spark.sql(f"SHOW TBLPROPERTIES {database}.{name} ('quality')").first()["value"]
        comment = c.spark.catalog.getTable(f"{database}.{name}").description
        parts.append(c.spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("layer"), F.lit(quality).alias("quality"), F.lit(bool(comment)).alias("commented"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def _written(c: Ctx, df: DataFrame, name: str) -> str:
    path = scratch_path(c.spark, name)
    df.write.parquet(path)
    return path


def _without_times(c: Ctx) -> DataFrame:
    """Ingest input in which some scans have no time."""
    untimed = F.startswith(F.md5(F.col("scan_id").cast("binary")), F.lit("0"))
    return c.raw_scans.withColumn("event_ts", F.when(~untimed, F.col("event_ts")))


def _outcomes(ledger_rows: DataFrame, rejects: DataFrame) -> DataFrame:
    return ledger_rows.select(F.col("event_id").alias("scan_id"), "event_ts", F.lit("ledger").alias("outcome")).unionByName(
        rejects.select("scan_id", "event_ts", F.col("reason").alias("outcome")))


def _snapshot_tail(c: Ctx) -> DataFrame:
    """D1 stored as of the ledger's midpoint, then brought current from the later events only."""
    cut = _half(c)
    path = scratch_path(c.spark, "inventory_snapshot")
    M.gold_inventory_summary(c.silver.filter(F.col("event_ts") < cut)).write.parquet(path)
    return ledger.inventory_snapshot_plus_tail(c.spark.read.parquet(path), c.silver.filter(F.col("event_ts") >= cut))


def _two_halves(c: Ctx) -> DataFrame:
    """E3 replayed in two steps: the first half, then the second half from its state."""
    cut = _half(c)
    first = lifecycle.signal_lifecycle(c.silver.filter(F.col("event_ts") < cut),
                                       c.acks.filter(F.col("event_ts") < cut), c.p)
    state = lifecycle.lifecycle_state(c.silver.filter(F.col("event_ts") < cut), first, cut)
    second = lifecycle.signal_lifecycle(c.silver.filter(F.col("event_ts") >= cut),
                                        c.acks.filter(F.col("event_ts") >= cut), c.p, initial=state)
    return first.unionByName(second)


def _debounce_two_halves(c: Ctx) -> DataFrame:
    """E4 run on the first half of the rescans, then on the second half from its state."""
    cut = _half(c)
    first = debounce.debounce(c.rescans.filter(F.col("event_ts") < cut), 3.0, params=c.p)
    second = debounce.debounce(c.rescans.filter(F.col("event_ts") >= cut), 3.0, params=c.p,
                               initial=debounce.debounce_state(first))
    return first.unionByName(second).select("event_id", "event_ts", "barcode_raw")


def _a5(c: Ctx) -> DataFrame:
    """A5: the ledger delivered in one batch, the batch retried, and half of it delivered again under another name."""
    rows, _ = ingest.ingest_scans(c.raw_scans, c.p)
    rows = c.spark.read.parquet(_written(c, rows, "ledger-rows"))
    path = scratch_path(c.spark, "scan_events")
    for part, batch in ((rows, "a"), (rows, "a"), (rows.filter(F.col("qty") % 2 == 0), "b")):
        ingest.append_scans(part, path, batch)
    return tables.bronze_scan_events(c.spark, path)


def _a6(c: Ctx) -> DataFrame:
    """As A5, for signal rows."""
    rows = c.spark.read.parquet(_written(c, c.signals, "signal-rows"))
    path = scratch_path(c.spark, "replenishment_signals")
    for part, batch in ((rows, "a"), (rows, "a"), (rows.filter(F.col("status") == "OPEN"), None)):
        sinks.append_signals(part, path, batch)
    return tables.bronze_replenishment_signals(c.spark, path)


def _a7(c: Ctx) -> DataFrame:
    """Slip files of all customers, written and read back: those accepted with media type and content, and the rejects."""
    root = scratch_path(c.spark, "slip-files")
    slipdata.write_files(slipdata.slip_files(c.spark, c.sf_dir), root)
    files, rejects = slips.load_slip_files(c.spark, root, SLIP_FILE_BYTES)
    name, none = F.substring_index("path", "/", -1).alias("file"), F.lit(None).cast("string")
    return files.select(name, "length", "media_type", F.sha2("content", 256).alias("sha256"), none.alias("reason")).unionByName(
        rejects.select(name, "length", none.alias("media_type"), none.alias("sha256"), "reason"))


def _b4(c: Ctx) -> DataFrame:
    """Counts of the scan rules, taken in the pass that writes the silver layer."""
    _, counts = M.write_layer(c.spark, "silver_scan_events", [c.bronze], scratch_path(c.spark, "expectations"))
    return c.spark.createDataFrame(counts, M.EXPECTATIONS.split(", ", 1)[1])


def _a8(c: Ctx) -> DataFrame:
    sinks.register_views(c.spark, c.bronze, c.signals)
    return c.spark.table("inventory_current")


def _a8s(c: Ctx) -> DataFrame:
    sinks.register_views(c.spark, c.bronze, c.signals)
    return c.spark.table("signals_current")


def _a9(c: Ctx) -> DataFrame:
    v1 = c.signals.select("signal_id", "created_ts", "item_id", F.col("triggered_at_qty").alias("current_qty"),
                          "reorder_point", "reorder_qty", "trigger_event_id", "status")
    return sinks.migrate_signals_v1_to_v2(v1)


def _ingest(c: Ctx, part: int) -> DataFrame:
    return ingest.ingest_scans(c.raw_scans, c.p)[part]


def _bulk(c: Ctx) -> DataFrame:
    lines = slips.valid_slip_lines(c.slip_lines).join(
        c.table("orders").select(F.col("o_orderkey").alias("slip_id"),
                                 F.col("o_orderdate").alias("received_ts"),
                                 F.concat(F.lit("clerk"), (F.col("o_custkey") % 9).cast("string"), F.lit("@example.com"))
                                 .alias("user_email")), "slip_id")
    return ingest.bulk_intake(lines, c.p)[0]


# the skew cases run on small tables: keys over this many rows are split there
HOT_CELL_ROWS = 5000
# the written slip files are small: some are over this size
SLIP_FILE_BYTES = 250

QUERIES: dict[str, Callable[[Ctx], DataFrame]] = {
    # A: sources, sinks, schema
    "bronze_scan_events": lambda c: tables.bronze_scan_events(c.spark, _written(c, c.bronze, "scan-log")),
    "bronze_replenishment_signals": lambda c: tables.bronze_replenishment_signals(c.spark, _written(c, c.signals, "signal-log")),
    "materialize": _a4,
    "materialize_layers": _layers,
    "append_scans": _a5,
    "append_signals": _a6,
    "load_slip_files": _a7,
    "inventory_current": _a8,
    "signals_current": _a8s,
    "migrate_signals_v1_to_v2": _a9,
    "migrate_scans_add_user_email": lambda c: sinks.migrate_scans_add_user_email(c.bronze.drop("user_email")),
    # B: projections, filters, quality
    "silver_scan_events": lambda c: c.silver,
    "silver_replenishment_signals": lambda c: c.silver_signals,
    "expect_or_drop": lambda c: quality.expect_or_drop(c.bronze, quality.SCAN_RULES),
    "expectation_metrics": _b4,
    "expectation_log": lambda c: quality.expectation_log_query(quality.quality_event_log(
        c.bronze, quality.SCAN_RULES, at=A.as_of_col(c.bronze))),
    "quarantine": lambda c: quality.quarantine(c.bronze, quality.SCAN_RULES)
    .withColumn("failed_rules", F.array_join("failed_rules", ",")),
    "with_below_reorder_point": lambda c: columns.with_below_reorder_point(ledger.all_inventory(c.bronze, None)),
    "with_stock_status": lambda c: columns.with_stock_status(c.inventory).select("item_id", "on_hand_qty",
                                                                                 "stock_status"),
    "inventory_item": lambda c: ledger.inventory_item(c.bronze, "PART-1"),
    "inventory_item_unknown": lambda c: ledger.inventory_item(c.bronze, "PART-NONE"),
    "on_hand_qty": lambda c: ledger.on_hand_qty(c.bronze, "PART-1"),
    "on_hand_qty_unknown": lambda c: ledger.on_hand_qty(c.bronze, "PART-NONE"),
    "signals_by_status": lambda c: _signal_cols(latest.signals_by_status(c.signals, "OPEN")),
    "items_at_or_below": lambda c: A.items_at_or_below(c.inventory, 10),
    "out_of_stock_items": lambda c: A.items_at_or_below(c.inventory, 0),
    "stale_items": lambda c: A.stale_items(c.inventory, c.silver, days=3),
    "urgent_open_signals": lambda c: A.urgent_open_signals(c.gold_open),
    "closeable_signals": lambda c: A.closeable_signals(c.gold_open),
    "depleting_items": lambda c: A.depleting_items(c.inventory),
    "balanced_items": lambda c: A.balanced_items(c.inventory),
    "valid_slip_lines": lambda c: slips.valid_slip_lines(c.slip_lines),
    "with_actor_name": lambda c: columns.with_actor_name(c.bronze).select("event_id", "user_email", "actor_name"),
    # C: joins
    "gold_open_replenishment_signals": lambda c: c.gold_open,
    "signals_with_live_stock": lambda c: latest.signals_with_live_stock(c.signals, c.bronze, None, 50),
    "signals_with_live_stock_open": lambda c: latest.signals_with_live_stock(c.signals, c.bronze, "OPEN", 50),
    "signals_dashboard_overlay": lambda c: latest.signals_dashboard_overlay(
        latest.signals_with_live_stock(c.signals, c.bronze, None, 50), ledger.all_inventory(c.bronze, 100)),
    "recent_activity": lambda c: ledger.recent_activity(c.bronze, 20),
    "orphan_signals": lambda c: _signal_cols(audits.orphan_signals(c.signals, c.bronze)),
    "signals_with_trigger_event": lambda c: audits.signals_with_trigger_event(c.signals, c.bronze),
    "new_signals": _c7,
    "acknowledge_signals": _c8,
    "fulfill_signals": _c9,
    "pct_items_with_open_signal": lambda c: latest.pct_items_with_open_signal(c.signals, c.inventory),
    "inventory_as_of": lambda c: ledger.inventory_as_of(c.silver, _probes(c), c.p),
    "signal_snapshot_audit": lambda c: lifecycle.signal_snapshot_audit(c.signals, c.silver, c.p),
    # D: aggregations
    "gold_inventory_summary": lambda c: c.inventory,
    "inventory_snapshot_plus_tail": _snapshot_tail,
    "all_inventory": lambda c: ledger.all_inventory(c.bronze, 100),
    "gold_daily_activity": lambda c: c.daily,
    "gold_replenishment_metrics": lambda c: M.gold_replenishment_metrics(c.silver_signals)
    .withColumn("avg_qty_below_reorder", F.round("avg_qty_below_reorder", 6)),
    "replenishment_sla": lambda c: A.replenishment_sla(c.silver_signals),
    "consumption_rate": lambda c: A.consumption_rate(c.silver, 7, c.as_of),
    "peak_hours": lambda c: A.peak_hours(c.silver),
    "frequent_low_items": lambda c: A.frequent_low_items(c.silver_signals),
    "open_signal_alert": lambda c: latest.open_signal_alert(c.signals, 0),
    "table_status": lambda c: A.table_status(c.bronze, c.signals),
    "dashboard_kpis": lambda c: A.dashboard_kpis(ledger.all_inventory(c.bronze, None), c.signals),
    "slip_totals": lambda c: slips.slip_totals(c.slip_lines),
    "bulk_totals": lambda c: slips.slip_totals(_bulk(c).withColumn(
        "slip_id", F.substring_index("event_id", "-", 1).cast("bigint"))),
    "usage_rate": lambda c: A.usage_rate(c.silver, 24 * 60, c.as_of),
    "time_since_last_scan": lambda c: A.time_since_last_scan(c.silver),
    "total_units": lambda c: A.total_units(c.inventory),
    "mean_time_to_acknowledge": lambda c: A.mean_time_to_acknowledge(c.silver_signals),
    "stations_activity": lambda c: A.stations_activity(c.silver),
    "intake_vs_consume": lambda c: A.intake_vs_consume(c.silver, 7, c.as_of),
    "unique_items_on": lambda c: A.unique_items_on(c.silver, as_of=c.as_of),
    "turnover_top_items": lambda c: A.turnover_top_items(c.running, c.inventory, 10),
    "signal_frequency": lambda c: A.signal_frequency(c.silver_signals),
    "daily_summary": lambda c: A.daily_summary(c.silver, c.signals, as_of=c.as_of),
    "demand_balance": lambda c: A.demand_balance(c.silver, c.silver_signals),
    # E: windows and ordered computations
    "latest_by": lambda c: _signal_cols(latest.latest_signals(c.signals)),
    "running_on_hand": lambda c: c.running.select("event_id", "item_id", "event_ts", "event_type", "qty",
                                                  "on_hand_qty"),
    "running_on_hand_lineitem": lambda c: ledger.running_on_hand(c.lineitem_scans, c.p)
    .select("event_id", "item_id", "event_ts", "on_hand_qty"),
    "signal_lifecycle": lambda c: c.signals,
    "signal_lifecycle_two_halves": _two_halves,
    "signal_lifecycle_no_acks": lambda c: lifecycle.signal_lifecycle(c.silver, None, c.p),
    "signal_lifecycle_lineitem": lambda c: lifecycle.signal_lifecycle(
        M.silver_scan_events(c.lineitem_scans), None, c.p),
    "signal_lifecycle_hot_item": lambda c: lifecycle.signal_lifecycle(
        bridge.with_hot_key(M.silver_scan_events(c.lineitem_scans), bridge.hex_source_id()), None,
        c.p.with_(scan_cell_rows=HOT_CELL_ROWS)),
    "debounce": lambda c: debounce.debounce(c.rescans, 3.0, params=c.p).select("event_id", "event_ts",
                                                                                "barcode_raw"),
    "debounce_two_halves": _debounce_two_halves,
    "debounce_48h": lambda c: debounce.debounce(c.rescans, 48 * 3600.0, params=c.p).select(
        "event_id", "event_ts", "barcode_raw"),
    "debounce_hot_48h": lambda c: debounce.debounce(
        bridge.with_hot_key(c.rescans, bridge.numeric_source_id()).withColumn("barcode_raw", F.when(
            F.col("item_id") == "PART-HOT", F.lit("ITEM=PART-HOT;QTY=1")).otherwise(F.col("barcode_raw"))),
        48 * 3600.0, params=c.p.with_(scan_cell_rows=HOT_CELL_ROWS)).select("event_id", "event_ts", "barcode_raw"),
    "debounce_adjacent": lambda c: debounce.debounce_adjacent(c.rescans, 3000, params=c.p).select(
        "event_id", "event_ts", "station_id", "barcode_raw"),
    "week_over_week": lambda c: A.week_over_week(c.silver),
    "receiving_forecast": lambda c: A.receiving_forecast(c.daily, 7),
    "daily_trend": lambda c: A.daily_trend(c.daily, c.silver, "CONSUME", 30),
    # F: sorts and top-k
    "recent_events": lambda c: ledger.recent_events(c.bronze, 20),
    "lowest_stock": lambda c: A.lowest_stock(c.inventory),
    "top_stock": lambda c: A.top_stock(c.inventory, 10),
    "high_velocity_items": lambda c: A.high_velocity_items(c.inventory, 10),
    "busiest_days": lambda c: A.busiest_days(c.daily, "INTAKE", None, 10),
    "busiest_days_this_month": lambda c: A.busiest_days(c.daily, "INTAKE", "as_of", 1, c.silver),
    "oldest_open_signals": lambda c: A.oldest_open_signals(c.gold_open, 10),
    "stockout_risk": lambda c: c.risk,
    "top_issues": lambda c: A.top_issues(c.inventory, c.gold_open, c.risk, c.silver, 5, c.as_of),
    # G: set operations
    "data_freshness": lambda c: A.data_freshness(c.bronze, c.signals),
    # H: scalar functions and compositions
    "parse_barcodes": lambda c: barcode.parse_barcodes(c.raw_scans).select(
        "scan_id", "barcode_raw", "parsed_item_id", "parsed_qty", "parse_error"),
    "parse_slip_responses": lambda c: c.slip_parsed.select(
        "slip_id", F.size("slip.items").alias("lines"), F.col("slip.po_number").alias("po_number"),
        F.col("slip.ship_date").alias("ship_date"), F.col("slip.notes").alias("notes")),
    "slip_lines": lambda c: c.slip_lines,
    "bulk_intake": _bulk,
    "ingest_scans": lambda c: _ingest(c, 0),
    "ingest_rejects": lambda c: _ingest(c, 1),
    "ingest_missing_times": lambda c: _outcomes(*ingest.ingest_scans(_without_times(c), c.p)),
    "ingest_default_times": lambda c: _outcomes(*ingest.ingest_scans(
        _without_times(c), c.p, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))),
    "make_barcode": lambda c: c.silver.select("event_id", barcode.make_barcode(F.col("item_id"), F.col("qty")).alias("barcode")),
    # audits
    "duplicate_event_ids": lambda c: quality.duplicate_event_ids(c.lineitem_scans),
    "multiple_open_items": lambda c: audits.multiple_open_items(c.signals),
    "check_violations": lambda c: quality.check_violations(c.bronze),
    "illegal_transitions": lambda c: audits.illegal_transitions(c.signals, c.p),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from stockledger.streaming import streams
    out = {k: _q(f) for k, f in QUERIES.items()}
    out.update(streams.stream_queries())
    return out
