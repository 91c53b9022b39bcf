"""Physical-plan properties: pushdown, pruning, partial aggregation, no pair joins."""

import tempfile

import pytest

import __spark_entry__ as E
from stockledger.operators import debounce, latest, ledger, lifecycle
from stockledger import schemas
from stockledger.plans import medallion as M, registry
from stockledger.sources import bridge, tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scan_log(spark):
    path = tempfile.mkdtemp(prefix="scanlog-") + "/scan_events"
    bridge.bridge_e(spark, SF).write.parquet(path)
    return tables.bronze_scan_events(spark, path)


def test_item_filter_reaches_scan(scan_log):
    p = _plan(ledger.inventory_item(scan_log, "PART-1"))
    assert "PushedFilters: [IsNotNull(item_id), EqualTo(item_id,PART-1)]" in p


def test_summary_reads_only_needed_columns(scan_log):
    p = _plan(M.gold_inventory_summary(M.silver_scan_events(scan_log)))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "barcode_raw" not in schema and "user_email" not in schema and "station_id" not in schema
    assert "PushedFilters" in p and "GreaterThan(qty,0)" in p


def test_latest_state_aggregates_before_shuffle(spark):
    sig = E.queries()["bronze_replenishment_signals"](spark, SF)
    p = _plan(latest.latest_signals(sig))
    assert "partial_max_by" in p


@pytest.mark.parametrize("name", sorted(k for k in registry.queries() if not k.startswith("stream_")
                                        and k not in ("materialize", "append_scans", "append_signals")))
def test_no_pair_producing_join(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


DAY_QUESTIONS = ("consumption_rate", "intake_vs_consume", "unique_items_on", "daily_summary", "usage_rate", "stockout_risk", "top_issues")


@pytest.mark.parametrize("name", DAY_QUESTIONS)
def test_day_questions_push_their_time_bounds_and_write_nothing(spark, name, monkeypatch):
    from pyspark.sql import DataFrameWriter
    write, paths = DataFrameWriter.parquet, []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: (paths.append(path), write(w, path, *a, **k))[1])
    df = registry.queries()[name](spark, SF)
    scans = [x for x in _plan(df).split("\n") if "FileScan parquet" in x]
    assert any("GreaterThan" in x.split("PushedFilters: ")[1] and "(ts," in x.split("PushedFilters: ")[1] for x in scans), scans
    # the replayed signal log notes which items are large (none here); no question writes rows of a log
    assert all("/large-keys-" in x for x in paths), paths


def test_day_questions_read_only_their_folders(spark):
    """On the stored layer the same bounds prune folders, and the newest event is taken from the last one."""
    from stockledger.operators import analytics
    from stockledger.session import scratch_path
    from stockledger.sources import sinks
    silver = M.silver_scan_events(bridge.bridge_e(spark, SF))
    path = sinks.materialize(silver, scratch_path(spark, "day-questions"), "silver_scan_events", "silver", ["event_date"])
    log = spark.read.parquet(path)
    as_of = analytics.newest_event(log, by_folder=True)
    for ask in (analytics.consumption_rate, analytics.intake_vs_consume, analytics.unique_items_on):
        out = ask(log, as_of=as_of)
        p = _plan(out)
        assert "PartitionFilters: [isnotnull(event_date" in p and "(event_ts," in p.split("PushedFilters: ")[1], p
        assert sorted(map(str, out.collect())) == sorted(map(str, ask(silver).collect()))


def test_status_figures_read_each_log_once(spark):
    from stockledger.operators import analytics
    log, sig = bridge.bridge_e(spark, SF), spark.read.schema(schemas.SIGNALS).parquet(_signals_path(spark))
    for out in (analytics.table_status(log, sig), analytics.daily_summary(M.silver_scan_events(log), sig, "2024-01-05")):
        assert _plan(out).count("FileScan parquet") == 2


def _signals_path(spark):
    path = tempfile.mkdtemp(prefix="signals-") + "/log"
    registry.queries()["signal_lifecycle"](spark, SF).write.parquet(path)
    return path


def _exchanges(p):
    return [x for x in p.split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]


def test_ordered_operators_exchange_the_ledger_once(spark):
    """Balance, previous label and open row of the replay share one exchange; nothing is persisted."""
    log = bridge.bridge_l(spark, SF)
    for out in (ledger.running_on_hand(log), lifecycle.signal_lifecycle(log), debounce.debounce(log, 3.0)):
        p = _plan(out)
        assert len(_exchanges(p)) == 1 and "InMemoryTableScan" not in p, p


def test_refresh_partitions_silver_by_date(spark):
    from pyspark.sql import functions as F
    from stockledger.session import scratch_path
    bronze = bridge.bridge_e(spark, SF)
    sig = E.queries()["bronze_replenishment_signals"](spark, SF)
    written = M.refresh(spark, bronze, sig, scratch_path(spark, "refresh-test"))
    assert "/silver/" in written["silver_scan_events"] and "/gold/" in written["gold_inventory_summary"]
    silver = spark.read.parquet(written["silver_scan_events"])
    p = _plan(silver.filter(F.col("event_date") == F.lit("2024-01-05").cast("date")))
    assert "PartitionFilters: [isnotnull(event_date" in p
