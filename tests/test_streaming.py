"""Stream forms give the batch result even when rows arrive out of order across micro-batches."""

import datetime as dt
import glob
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stockledger.operators import debounce, lifecycle
from stockledger.sources import bridge
from stockledger.streaming import streams

SF = "/root/testdata/sf0.001"


def _out_of_order(spark, rows, marker):
    """A file stream of ``rows`` in four time chunks; rows in the last 5 minutes before a boundary come one batch late."""
    bounds = rows.agg(F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi")).first()
    lo, span = int(bounds.lo.timestamp() * 1e6), int((bounds.hi - bounds.lo).total_seconds() * 1e6 / 4)
    t = F.unix_micros(F.col("event_ts").cast("timestamp"))
    chunk = F.least(F.floor((t - F.lit(lo)) / F.lit(span)), F.lit(3)).cast("int")
    near_end = t > F.lit(lo) + (chunk + 1) * F.lit(span) - F.lit(300_000_000)
    staged = rows.withColumn("batch", F.when(near_end & (chunk < 3), chunk + 1).otherwise(chunk))
    root = tempfile.mkdtemp(prefix="ooo-")
    for b in range(4):
        staged.filter(F.col("batch") == b).drop("batch").orderBy(F.rand(7)).coalesce(1).write.parquet(f"{root}/part={b:02d}")
    end = streams.closing_marker(rows.agg(F.max("event_ts").alias("m")), marker)
    end.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]).coalesce(1).write.parquet(f"{root}/part=04")
    # the file source takes files in modification-time order: make that the batch order
    for b in range(5):
        for f in glob.glob(f"{root}/part={b:02d}/*.parquet"):
            os.utime(f, (1_700_000_000 + b * 100, 1_700_000_000 + b * 100))
    return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root + "/*/*.parquet")
            .withColumn("event_ts", F.col("event_ts").cast("timestamp")))


def test_debounce_stream_out_of_order(spark):
    rescans = bridge.rescans(bridge.bridge_e(spark, SF)).select("event_id", "event_ts", "barcode_raw")
    src = _out_of_order(spark, rescans, {"event_id": "__closing__", "event_ts": "ts", "barcode_raw": "__closing__"})
    got = streams.run_to_parquet(streams.debounce_stream(src, None, 3.0), "ooo", state_store=streams.ROCKSDB)
    want = debounce.debounce(rescans, 3.0)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_lifecycle_stream_out_of_order_with_odd_ids(spark):
    """Batches cut and shuffled, ids beyond long and below zero: the rows of the batch replay."""
    scans = bridge.bridge_e(spark, SF).withColumn("event_id", F.when(F.col("event_id") == "7", F.lit("12345678901234567890"))
                                                  .when(F.col("event_id") == "5", F.lit("-5")).otherwise(F.col("event_id")))
    scans = scans.filter("event_type in ('INTAKE', 'CONSUME') and qty > 0")
    led = scans.select("item_id", "event_ts", "event_id", F.col("event_type").alias("kind"),
                       F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(-F.col("qty")).cast("bigint").alias("delta"))
    counts = streams.LateRows()
    src = _out_of_order(spark, led, {"item_id": "__closing__", "event_ts": "ts", "event_id": "__closing__", "kind": "NONE", "delta": 0})
    got = streams.run_to_parquet(streams.lifecycle_stream(src.withWatermark("event_ts", streams.WATERMARK_DELAY)), "ooo-lifecycle", state_store=streams.ROCKSDB, late=counts)
    want = lifecycle.signal_lifecycle(scans)
    # nothing waits behind the watermark: one row per item is kept, besides the marker's few
    items = led.select("item_id").distinct().count()
    assert items <= counts.state_rows <= items + 8
    rows = lambda df: sorted(map(str, df.withColumn("created_ts", F.col("created_ts").cast("timestamp_ntz")).collect()))
    assert rows(got) == rows(want)


def test_sink_repeats_nothing_when_a_batch_is_retried(spark):
    out = tempfile.mkdtemp(prefix="sink-") + "/out"
    write = streams.epoch_sink(out)
    for epoch in (0, 1, 1, 0):
        write(spark.range(epoch * 10, epoch * 10 + 3), epoch)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 10, 11, 12]


def test_changes_compact_to_the_same_rows(spark):
    root = tempfile.mkdtemp(prefix="changes-")
    write = streams.epoch_sink(f"{root}/log")
    for epoch in range(4):
        write(spark.createDataFrame([(k, epoch) for k in range(epoch, 6)], "k int, v int"), epoch)
    log = spark.read.parquet(f"{root}/log")
    want = {(r.k, r.v) for r in streams.current_from_changes(log, ["k"]).collect()}
    snap = spark.read.parquet(streams.compact_changes(f"{root}/log", f"{root}/snap", ["k"], 2))
    got = {(r.k, r.v) for r in streams.current_from_changes(log, ["k"], snap.select(*log.columns), 2).collect()}
    assert got == want and snap.count() == 6


def test_open_changes_across_batches(spark):
    root = tempfile.mkdtemp(prefix="open-")
    ddl = "id bigint, signal_id string, created_ts timestamp_ntz, status string"
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    batches = [[(1, "a", days[0], "OPEN"), (2, "b", days[0], "OPEN")], [(3, "a", days[1], "ACKNOWLEDGED"), (4, "c", days[1], "OPEN")],
               [(5, "a", days[0], "OPEN"), (6, "b", days[2], "FULFILLED"), (7, "d", days[2], "FULFILLED")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(root)
    changes = streams.run_to_parquet(streams.open_changes(stream), "open-changes", state_store=streams.ROCKSDB)
    assert streams.alert_row(changes).first().open_count == 1
    assert changes.count() <= 5


def test_every_late_row_of_150_batches_is_counted(spark):
    """More micro-batches than a query keeps progress records of: from the third on, each brings one late row."""
    root = tempfile.mkdtemp(prefix="late-")
    t0 = dt.datetime(2024, 1, 1)
    for i in range(150):
        late = [(f"late{i}", t0 - dt.timedelta(days=1))] if i >= 2 else []
        pq.write_table(pa.Table.from_pylist([{"event_id": k, "event_ts": t} for k, t in [(f"e{i}", t0 + dt.timedelta(hours=i)), *late]],
                                            pa.schema([("event_id", pa.string()), ("event_ts", pa.timestamp("us", "UTC"))])), f"{root}/{i:03d}.parquet")
        os.utime(f"{root}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    counted = streams.LateRows()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        src = spark.readStream.schema("event_id string, event_ts timestamp").option("maxFilesPerTrigger", 1).parquet(root)
        got = streams.run_to_parquet(src.withWatermark("event_ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]), "late-150", late=counted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert counted.dropped == 148 and got.count() == 150


SIGNAL_ROWS = "id bigint, signal_id string, created_ts timestamp_ntz, status string"


def _signal_files(spark, batches):
    """A stream of one batch per file."""
    root = tempfile.mkdtemp(prefix="signals-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SIGNAL_ROWS).coalesce(1).write.parquet(f"{root}/n={i}")
        for f in glob.glob(f"{root}/n={i}/*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SIGNAL_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{root}/*/*.parquet")


def test_closed_signals_are_forgotten_and_open_ones_kept(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[(i, f"s{i}", day(0), "OPEN") for i in range(50)], [(100 + i, f"s{i}", day(1), "FULFILLED") for i in range(45)],
               [(300, "far", day(30), "OPEN")], [(301, "far2", day(31), "OPEN")], [(302, "s0", day(32), "OPEN")]]
    counts = streams.LateRows()
    changes = streams.run_to_parquet(streams.open_changes(_signal_files(spark, batches)), "expiry", state_store=streams.ROCKSDB, late=counts)
    assert streams.alert_row(changes).first().open_count == 5 + 3 and counts.dropped == 0
    assert counts.state_rows == 5 + 3      # of the 45 closed ones only s0 is back


def test_live_alert_reads_one_folder_and_survives_a_retry(spark):
    out = tempfile.mkdtemp(prefix="alert-") + "/alerts"
    sink = streams.alert_sink(out, threshold=2)
    batch = lambda *c: spark.createDataFrame([("s", x) for x in c], "signal_id string, change int")
    for epoch, changes in ((0, (1, 1, 1)), (1, (-1,)), (1, (-1,)), (2, ()), (2, ()), (3, (1, 1, -1))):
        sink(batch(*changes), epoch)
    rows = {e: tuple(spark.read.parquet(f"{out}/__epoch={e}").first())[:2] for e in range(4)}
    assert rows == {0: (3, True), 1: (2, False), 2: (2, False), 3: (3, True)}
    # earlier folders are not needed any more
    for f in glob.glob(f"{out}/__epoch=[0-2]/*"):
        os.unlink(f)
    sink(batch(1), 4)
    assert spark.read.parquet(f"{out}/__epoch=4").first().open_count == 4


def test_live_alert_runs(spark):
    t = dt.datetime(2024, 1, 1)
    stream = _signal_files(spark, [[(1, "a", t, "OPEN"), (2, "b", t, "OPEN")], [(3, "a", t + dt.timedelta(hours=1), "ACKNOWLEDGED")]])
    out = tempfile.mkdtemp(prefix="live-")
    q = streams.start_open_alert(stream, out, out + "/checkpoint", threshold=1, every="0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(out + "/alerts").orderBy("__epoch").collect()
    assert [r.open_count for r in rows][:2] == [2, 1] and rows[0].triggered and not rows[-1].triggered


def test_keys_share_calls_and_state(spark):
    """However many keys there are, a stream calls and keeps state for a fixed number of buckets; keys of a bucket stay apart."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"e{k}-{s}", t0 + dt.timedelta(seconds=s), None if k == 0 else f"c{k}") for k in range(3000) for s in (0, 2, 4, 7)]
    root = tempfile.mkdtemp(prefix="keys-") + "/t"
    spark.createDataFrame([*rows, ("__closing__", t0 + dt.timedelta(days=1), "__closing__")], "event_id string, event_ts timestamp, barcode_raw string") \
        .coalesce(1).write.parquet(root)
    src = spark.readStream.schema("event_id string, event_ts timestamp, barcode_raw string").parquet(root)
    staged = streams.debounce_stream(src, None, 3.0)
    counts = streams.LateRows()
    got = streams.run_to_parquet(staged, "buckets", state_store=streams.ROCKSDB, late=counts)
    assert sorted(r.event_id for r in got.collect()) == sorted(f"e{k}-{s}" for k in range(3000) for s in (0, 4, 7))
    assert spark.read.parquet(root).select(streams.bucket("barcode_raw").alias("b")).distinct().count() <= streams.BUCKETS
