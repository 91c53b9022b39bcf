"""Streaming forms that give the batch results on the same input.

The source is the ``events`` table read as a file stream; the bridge, the
quality rules and the aggregates are the batch functions applied to the
streaming frame.  Sinks write Parquet from ``foreachBatch`` into the shared
checkpoint folder (never the driver's memory), one folder per micro-batch: a
batch that is retried overwrites its own folder and repeats nothing.  The
registry reads the sink back as a batch frame.  Event time is cast to
TIMESTAMP for watermarks.

Stateful per-key logic (debounce, lifecycle) uses ``transformWithStateInPandas``:
keys are dealt into a fixed number of buckets, rows wait in a list state, and the
rows the watermark has passed are taken in (key, time, id) order as arrays and
applied to what is kept of their keys; Spark partitions the buckets across
executors and keeps the state in its fault-tolerant state store.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from stockledger.config import ALERT_SUMMARY_FORMAT, DEFAULT, Params
from stockledger.operators.debounce import walk_on
from stockledger.operators.latest import latest_by, signal_order, status_rank
from stockledger.operators.lifecycle import numeric_id
from stockledger.plans import medallion as M
from stockledger.session import apply_conf, scratch_path
from stockledger.sources import bridge

EPOCH = "__epoch"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a file stream (schema taken from the table)."""
    schema = bridge.read_table(spark, sf_dir, "events").schema
    return (spark.readStream.format("parquet").schema(schema)
            .option("pathGlobFilter", "events.parquet").load(sf_dir))


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge E on the stream, event time as TIMESTAMP."""
    return bridge.scans_from_events(event_stream(spark, sf_dir)) \
        .withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def epoch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to its own folder below ``out``."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{EPOCH}={epoch}")
    return sink


class LateRows(StreamingQueryListener):
    """Adds up, over all micro-batches, the rows that stateful operators dropped as late; also the state rows now held.

    A query keeps its last 100 progress records only; a listener sees every one.
    """

    def __init__(self):
        self.dropped, self.state_rows, self._ended, self._waits = 0, 0, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._waits:
            self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
            self.state_rows = sum(op.numRowsTotal for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self._waits:
            self._ended.add(str(event.runId))
            self._waits.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60) -> None:
        """Until all events of a run have come: its termination is the last of them."""
        with self._waits:
            if not self._waits.wait_for(lambda: run_id in self._ended, seconds):
                raise TimeoutError(f"no termination event of stream run {run_id}")


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", with_epoch: bool = False,
                   late: LateRows | None = None, deliveries: Sequence[Callable[[], None]] = (lambda: None,),
                   state_store: str | None = None) -> DataFrame:
    """Run a streaming frame to completion (availableNow) into Parquet; return the stored result.

    ``with_epoch`` keeps the number of each row's micro-batch (for update-mode
    change logs read back as latest row per key); ``late`` counts the rows dropped
    as late; ``deliveries`` are called in turn, the stream running after each
    of them from where it stopped; ``state_store`` is the provider for this stream.
    """
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"ckpt-{name}")
    # a first folder without rows gives the result its schema whatever arrives
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/{EPOCH}=-1")
    if late is not None:
        spark.streams.addListener(late)
    store = spark.conf.get(STATE_STORE)
    if state_store is not None:
        spark.conf.set(STATE_STORE, state_store)
    try:
        for deliver in deliveries:
            deliver()
            q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                 .foreachBatch(epoch_sink(out)).trigger(availableNow=True).start())
            q.awaitTermination()
            if late is not None:
                late.wait_for(str(q.runId))
    finally:
        spark.conf.set(STATE_STORE, store)
        if late is not None:
            spark.streams.removeListener(late)
    stored = spark.read.parquet(out)
    return stored.withColumn(EPOCH, F.col(EPOCH).cast("bigint")) if with_epoch else stored.drop(EPOCH)


def compact_changes(changes: str, snapshot: str, keys: list[str], upto: int) -> str:
    """Fold an update-mode change log up to a micro-batch into one row per key.

    Readers take the snapshot and the later folders; folders up to ``upto`` and
    earlier snapshots may then be removed by retention rules.
    """
    spark = SparkSession.getActiveSession()
    log = spark.read.parquet(changes)
    path = f"{snapshot}/upto={upto}"
    latest_by(log.filter(F.col(EPOCH) <= upto), keys, [F.col(EPOCH)]).write.mode("overwrite").parquet(path)
    return path


def current_from_changes(changes: DataFrame, keys: list[str], snapshot: DataFrame | None = None, upto: int = -1) -> DataFrame:
    """Latest row per key of an update-mode change log (highest batch number), over a compacted snapshot if there is one."""
    if snapshot is not None:
        changes = changes.filter(F.col(EPOCH) > upto).unionByName(snapshot)
    return latest_by(changes, keys, [F.col(EPOCH)]).drop(EPOCH)


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


# ---- I1-I4, I7, I9: stateless and aggregate forms --------------------------------------------

def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rules on the stream (append)."""
    s = M.silver_scan_events(scan_stream(spark, sf_dir))
    return run_to_parquet(s, "silver").withColumn("event_ts", _ntz("event_ts"))


_SCAN_MARKER = {"event_id": "__closing__", "event_ts": "ts", "event_type": "MARKER", "station_id": "",
                "barcode_raw": "", "item_id": "", "qty": 0, "user_email": ""}


def _is_marker():
    return F.col("event_id") == "__closing__"


def _closed_scan_stream(spark: SparkSession, sf_dir: str, delay: str, after_days: int) -> DataFrame:
    """Silver scan stream + closing marker, watermarked.

    Catalyst pushes filters below the watermark operator, so every filter lets
    the marker through (``| _is_marker()``); the marker then forms a window of
    its own that never closes, so it is never written.
    """
    from stockledger.operators.quality import SCAN_RULES
    end = bridge.read_table(spark, sf_dir, "events").agg(F.max("ts").alias("m"))
    s = _with_closing_marker(scan_stream(spark, sf_dir), end, _SCAN_MARKER, after_days)
    rules = F.expr(" AND ".join(f"({r})" for r in SCAN_RULES.values()))
    return (s.withWatermark("event_ts", delay).filter(_is_marker() | rules)
            .withColumn("event_date", F.to_date("event_ts")).withColumn("event_hour", F.hour("event_ts")))


def stream_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling 1-day windows in append mode: a window is written once, when the
    watermark (1 day delay) has passed its end, and its state is then dropped.

    Distinct counts are exact and take two levels: one state row per (window,
    type, item) and per (window, type, station), spread by key, whose number is
    then counted per (window, type); no state row holds a set."""
    s = _closed_scan_stream(spark, sf_dir, "1 day", 3)
    keyed = s.withColumn("k", F.explode(F.array(F.struct(F.lit("item").alias("of"), F.col("item_id").alias("key")),
                                                F.struct(F.lit("station").alias("of"), F.col("station_id").alias("key")))))
    each = keyed.groupBy(F.window("event_ts", "1 day").alias("w"), "event_type", "k.of", "k.key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"))
    item = F.col("of") == "item"
    agg = each.groupBy(F.window("w", "1 day").alias("d"), "event_type").agg(
        F.sum(F.when(item, F.col("n"))).alias("event_count"), F.sum(F.when(item, F.col("q"))).alias("total_qty"),
        F.count(F.when(item, F.col("key"))).alias("unique_items"), F.count(F.when(~item, F.col("key"))).alias("unique_stations"))
    out = agg.select(F.to_date(F.col("d.start")).alias("event_date"), "event_type", "event_count", "total_qty",
                     "unique_items", "unique_stations")
    return run_to_parquet(out, "daily")


def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock summary as running totals.  Update mode: each trigger appends only
    the items that changed; the current summary is the latest row per item."""
    g = M.gold_inventory_summary(M.silver_scan_events(scan_stream(spark, sf_dir)))
    changes = run_to_parquet(g, "inventory", mode="update", with_epoch=True)
    return current_from_changes(changes, ["item_id"]).select(*g.columns) \
        .withColumn("last_activity", _ntz("last_activity"))


def stream_usage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: consumption per item over sliding 15-minute windows every minute, append mode
    (each window written once after the watermark passes it; state then dropped)."""
    s = _closed_scan_stream(spark, sf_dir, "15 minutes", 1).filter(
        _is_marker() | (F.col("event_type") == "CONSUME"))
    agg = s.groupBy(F.window("event_ts", "15 minutes", "1 minute").alias("w"), "item_id") \
        .agg(F.sum("qty").alias("consumed_qty"))
    out = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"), "item_id", "consumed_qty")
    return run_to_parquet(out, "usage")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream delivered twice; repeats dropped by event id within the watermark."""
    a = scan_stream(spark, sf_dir)
    b = scan_stream(spark, sf_dir)
    d = a.unionByName(b).withWatermark("event_ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return run_to_parquet(d, "dedupe").withColumn("event_ts", _ntz("event_ts"))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events is delivered after all others; those behind the watermark are
    dropped by the de-duplication and counted.  One row: delivered, kept, late.

    Three deliveries in turn, each a folder written by all its tasks and followed by a run of the
    stream.  The second repeats the newest event: rows are late only for a watermark that an
    earlier batch has already worked with."""
    path = scratch_path(spark, "late-events")
    ev = bridge.scans_from_events(bridge.read_table(spark, sf_dir, "events")).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    tenth = F.col("event_id").cast("bigint") % 10 == 0
    on_time = ev.filter(~tenth)
    newest = on_time.filter(F.col("event_ts") == on_time.agg(F.max("event_ts")).scalar())
    spark.createDataFrame([], ev.schema).write.parquet(f"{path}/n=none")
    stream = spark.readStream.schema(ev.schema).parquet(f"{path}/*")
    late = LateRows()
    kept = run_to_parquet(
        stream.withWatermark("event_ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]), "late", late=late,
        deliveries=[lambda part=part, n=n: part.write.parquet(f"{path}/n={n}") for n, part in enumerate((on_time, newest, ev.filter(tenth)))])
    delivered = spark.read.schema(ev.schema).parquet(f"{path}/*").agg(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("kept")).select(delivered.alias("delivered"), "kept", F.lit(late.dropped).cast("bigint").alias("late"))


# ---- I5, I6: per-key state, applied in event-time order ---------------------------------------
#
# Keys are dealt into ``BUCKETS`` groups by hash, since a call for a group costs far more
# than a row: the number of calls stays fixed however many keys there are.
# Rows of a bucket wait in a list state until the watermark has passed them (no
# earlier row can still arrive: older rows are dropped as late), then are
# applied in (key, time, id) order, all keys of the bucket together.  Arriving rows
# are appended to the list, nothing that waits is rewritten; an event-time timer at
# the earliest waiting row calls the bucket when the watermark has passed it, and only
# then is the list read, its passed rows applied and the rest put back.  Results do
# not depend on how rows are cut into micro-batches.  The list holds at most the rows
# of one watermark delay and what is kept of a key has a fixed size; a timer removes
# it once it can no longer matter.  For a bounded replay a closing marker, later
# than every event by more than the delay, moves the watermark past the end.

WATERMARK_DELAY = "10 minutes"
# ``transformWithState`` needs this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 1024


def bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Kept:
    """What a bucket keeps of its keys: {key: tuple}, held as one state value of one array a field."""

    def __init__(self, handle: StatefulProcessorHandle, fields: str):
        names = ["key string", *fields.split(", ")]
        self.state = handle.getValueState("kept", ", ".join(f"{n.split()[0]} array<{n.split()[1]}>" for n in names))

    def get(self) -> dict:
        if not self.state.exists():
            return {}
        key, *fields = self.state.get()
        return dict(zip(key, zip(*fields)))

    def put(self, kept: dict) -> None:
        if kept:
            self.state.update((list(kept), *map(list, zip(*kept.values()))))
        else:
            self.state.clear()


class InOrder(StatefulProcessor):
    """Calls ``apply(rows, first, kept) -> columns`` with a bucket's rows in (key, time, id) order.

    ``row``: DDL of a waiting row, key, ``t`` (microseconds) and id first; ``fields``: DDL of what is
    kept of a key; ``first`` marks each key's first row; ``apply`` brings ``kept`` up to date.
    ``expires(*fields)`` is the time (microseconds) after which what is kept of a key is of no use.
    """

    def __init__(self, apply, row: str, fields: str, out_cols: list[str], expires=None):
        self.apply, self.row, self.fields, self.out_cols, self.expires = apply, row, fields, out_cols, expires
        self.cols = [c.split()[0] for c in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.kept = Kept(handle, self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for f in rows:
            if len(f):
                self.waiting.appendList(self._tuples(f))
                earliest.append(int(f["t"].min()))
        if earliest:
            self._call_at(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.cols).astype({"t": "int64"})
        ready, rest = rows[rows["t"] < passed], rows[rows["t"] >= passed]
        kept = self.kept.get()
        if len(ready):
            ready = ready.assign(__key=pd.factorize(ready["key"])[0]).sort_values(["__key", *self.cols[1:3]], kind="stable")
            first = np.diff(ready["__key"].to_numpy(), prepend=-2) != 0
            out = self.apply(ready, first, kept)
            if len(rest):
                self.waiting.put(self._tuples(rest))
            else:
                self.waiting.clear()
            if len(out[0]):
                yield pd.DataFrame(dict(zip(self.out_cols, out)))
        until = {k: self.expires(*v) for k, v in kept.items()} if self.expires else {}
        gone = [k for k, u in until.items() if u < passed]
        for k in gone:
            del kept[k], until[k]
        if len(ready) or gone:
            self.kept.put(kept)
        calls = [*until.values(), *([int(rest["t"].min())] if len(rest) else [])]
        if calls:
            self._call_at(min(calls))

    def close(self) -> None:
        pass

    def _tuples(self, f: pd.DataFrame) -> list[tuple]:
        return list(zip(*(f[c].tolist() for c in self.cols)))

    def _call_at(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)


def closing_marker(end: DataFrame, columns: dict, after_days: int = 1) -> DataFrame:
    """One-row batch frame: ``end``'s time ``m`` + ``after_days`` in the "ts" column, fixed values elsewhere."""
    return end.select(*[(F.col("m").cast("timestamp") + F.make_dt_interval(days=F.lit(after_days))).alias(c)
                        if v == "ts" else F.lit(v).alias(c) for c, v in columns.items()])


def _with_closing_marker(stream: DataFrame, end: DataFrame, columns: dict, after_days: int = 1) -> DataFrame:
    """Union a closing marker into a bounded replay read in one micro-batch (the
    ``events`` file).  A replay cut into several batches must instead append the
    marker as its last file, since a separate source would be read at once."""
    spark = stream.sparkSession
    marker = closing_marker(end, columns, after_days)
    path = scratch_path(spark, "closing-marker")
    marker.write.parquet(path)
    marker_stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream.unionByName(marker_stream.select(*[F.col(c).cast(stream.schema[c].dataType) for c in columns]))


def _debounce_apply(window_us: int):
    """Kept: last kept time.  The walk steps over kept scans only."""
    def apply(rows: pd.DataFrame, first: np.ndarray, kept: dict):
        t, keys, heads = rows["t"].to_numpy(np.int64), rows["key"].to_numpy(object), np.flatnonzero(first)
        last = np.array([kept[k][0] if k in kept else t[i] - window_us for i, k in zip(heads, keys[heads])], dtype=np.int64)
        goes_on = t[heads] - last < window_us
        start = first | (np.diff(t, prepend=t[:1]) >= window_us)
        start[heads] = ~goes_on
        at = np.flatnonzero(walk_on(t, start, window_us, heads[goes_on], last[goes_on])[0])
        kept.update(zip(keys[at], zip(t[at].tolist())))
        return [rows["id"].to_numpy()[at], pd.to_datetime(t[at], unit="us"), keys[at]]
    return apply


def debounce_stream(scans: DataFrame, end: DataFrame | None = None, window_s: float = 3.0) -> DataFrame:
    """E4 on a stream of (event_id, event_ts TIMESTAMP, barcode_raw); ``end`` (one row,
    column ``m``) closes a bounded replay.  Returns the streaming frame of kept scans.

    A code's state goes once the watermark is a window past its last kept scan."""
    s = scans.select("event_id", "event_ts", "barcode_raw")
    if end is not None:
        s = _with_closing_marker(s, end, {"event_id": "__closing__", "event_ts": "ts",
                                          "barcode_raw": "__closing__"})
    s = s.withWatermark("event_ts", WATERMARK_DELAY).select(
        bucket("barcode_raw").alias("bucket"), F.col("barcode_raw").alias("key"), "event_ts", F.unix_micros("event_ts").alias("t"), F.col("event_id").alias("id"))
    window = int(window_s * 1_000_000)
    return s.groupBy("bucket").transformWithStateInPandas(
        InOrder(_debounce_apply(window), "key string, t long, id string", "last long", ["event_id", "event_ts", "barcode_raw"], lambda last: last + window),
        "event_id string, event_ts timestamp, barcode_raw string", "append", "EventTime")


def stream_debounce(spark: SparkSession, sf_dir: str, window_s: float = 3.0) -> DataFrame:
    """E4 keyed by barcode; state = last kept time (+ rows waiting for the watermark)."""
    end = bridge.read_table(spark, sf_dir, "events").agg(F.max("ts").alias("m"))
    out = debounce_stream(_rescan_stream(spark, sf_dir), end, window_s)
    return run_to_parquet(out, "debounce", state_store=ROCKSDB).withColumn("event_ts", _ntz("event_ts"))


def _rescan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge R on the stream (stateless: filter + explode)."""
    return bridge.rescans(scan_stream(spark, sf_dir).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))) \
        .withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def _lifecycle_apply(reorder_point: int):
    """Kept: balance, open event id, open quantity.  E3's labels, as arrays: a row emits iff it is O and
    the label before is not, or it is F or A and the label before is O."""
    def apply(rows: pd.DataFrame, first: np.ndarray, kept: dict):
        keys, heads = rows["key"].to_numpy(object), np.flatnonzero(first)
        held = [kept.get(k, (0, None, None)) for k in keys[heads]]
        number = np.cumsum(first) - 1       # of the row's key among the bucket's
        delta = rows["delta"].to_numpy(np.int64)
        moved = np.cumsum(delta)
        balance = moved + (np.array([h[0] for h in held], dtype=np.int64) - moved[heads] + delta[heads])[number]
        kind = rows["kind"].to_numpy(object)
        label = np.select([(kind == "CONSUME") & (balance <= reorder_point), (kind == "INTAKE") & (balance > reorder_point), kind == "ACK"],
                          ["OPEN", "FULFILLED", "ACKNOWLEDGED"], default="")
        at = np.flatnonzero(label != "")
        opens = label[at] == "OPEN"
        before = np.concatenate(([False], opens[:-1])) if len(at) else opens
        new = np.diff(number[at], prepend=-1) != 0
        before[new] = np.array([h[1] is not None for h in held], dtype=bool)[number[at[new]]]
        at = at[opens != before]
        ids, t = rows["id"].to_numpy(object)[at], rows["t"].to_numpy(np.int64)[at]
        # a key's emitted rows alternate: a closing row's signal is the one now open
        now, heads_out = [h[1:] for h in held], []
        for n, i, q, status in zip(number[at].tolist(), ids, balance[at].tolist(), label[at]):
            if status == "OPEN":
                now[n] = (i, q)
            heads_out.append(now[n])
            if status != "OPEN":
                now[n] = (None, None)
        ends = np.append(heads[1:], len(rows)) - 1
        kept.update((k, (q, *o)) for k, q, o in zip(keys[heads], balance[ends].tolist(), now))
        return [ids, pd.to_datetime(t, unit="us"), keys[at], [h[0] for h in heads_out], [h[1] for h in heads_out], label[at]]
    return apply


def lifecycle_stream(ledger: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """E3 on a stream of (item_id, event_ts TIMESTAMP, event_id, kind, delta) with a watermark."""
    led = ledger.select(bucket("item_id").alias("bucket"), F.col("item_id").alias("key"), "event_ts", F.unix_micros("event_ts").alias("t"),
                        F.col("event_id").alias("id"), "kind", "delta")
    names = ["event_id", "created_ts", "item_id", "open_event_id", "open_qty", "status"]
    out = led.groupBy("bucket").transformWithStateInPandas(
        InOrder(_lifecycle_apply(params.reorder_point), "key string, t long, id string, kind string, delta long", "balance long, open_id string, open_qty long", names),
        "event_id string, created_ts timestamp, item_id string, open_event_id string, open_qty long, status string", "append", "EventTime")
    return out.select(
        numeric_id(F.col("event_id")).alias("id"), F.md5(F.concat_ws("|", "item_id", "open_event_id")).alias("signal_id"), "created_ts",
        "item_id", F.col("open_qty").alias("triggered_at_qty"), F.lit(params.reorder_point).alias("reorder_point"),
        F.lit(params.reorder_qty).alias("reorder_qty"),
        F.when(F.col("status") == "ACKNOWLEDGED", F.col("open_event_id")).otherwise(F.col("event_id")).alias("trigger_event_id"), "status")


def stream_signal_lifecycle(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    """E3 keyed by item; state = (balance, open signal) (+ rows waiting for the watermark)."""
    bronze = scan_stream(spark, sf_dir)
    silver = M.silver_scan_events(bronze)
    mv = silver.select("item_id", "event_ts", "event_id", F.col("event_type").alias("kind"),
                       F.when(F.col("event_type") == "INTAKE", F.col("qty")).otherwise(-F.col("qty"))
                       .cast("bigint").alias("delta"))
    ak = bronze.filter(F.col("event_type") == "ERROR").select(
        "item_id", "event_ts", "event_id", F.lit("ACK").alias("kind"), F.lit(0).cast("bigint").alias("delta"))
    end = bridge.read_table(spark, sf_dir, "events").agg(F.max("ts").alias("m"))
    led = _with_closing_marker(mv.unionByName(ak), end,
                               {"item_id": "__closing__", "event_ts": "ts", "event_id": "__closing__",
                                "kind": "NONE", "delta": 0})
    out = lifecycle_stream(led.withWatermark("event_ts", WATERMARK_DELAY), params)
    return run_to_parquet(out, "lifecycle", state_store=ROCKSDB).withColumn("created_ts", _ntz("created_ts"))


def _signal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored output of I6, read as a file stream."""
    path = scratch_path(spark, "signals")
    stream_signal_lifecycle(spark, sf_dir).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def stream_latest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per signal over a stream of signal rows."""
    cur = latest_by(_signal_stream(spark, sf_dir), ["signal_id"], signal_order())
    # update mode: each trigger appends the signals that changed
    changes = run_to_parquet(cur, "latest", mode="update", with_epoch=True)
    return current_from_changes(changes, ["signal_id"]).select(*cur.columns) \
        .withColumn("created_ts", _ntz("created_ts"))


class OpenChange(StatefulProcessor):
    """Keeps order and openness of each signal's newest row, a bucket of signals at a time; gives +1 / -1 when a
    signal becomes open / stops being so.

    A signal that is not open is forgotten once the watermark has passed its newest row: rows older
    than that are dropped as late, and any later row is then its newest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = Kept(handle, "t long, i long, r int, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, changes = self.kept.get(), {}
        f = pd.concat(list(rows), ignore_index=True)
        for signal, *row in zip(*(f[c].tolist() for c in ("signal_id", "t", "i", "r", "open"))):
            held, row = newest.get(signal), tuple(row)
            if held is None or row > held:
                newest[signal] = row
                changes[signal] = changes.get(signal, 0) + int(row[3]) - int(bool(held and held[3]))
        self.kept.put(newest)
        self._call_at_next(newest)
        changes = {k: n for k, n in changes.items() if n}
        if changes:
            yield pd.DataFrame({"signal_id": list(changes), "change": list(changes.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, newest = timerValues.getCurrentWatermarkInMs() * 1000, self.kept.get()
        left = {k: v for k, v in newest.items() if v[3] or v[0] >= passed}
        if len(left) < len(newest):
            self.kept.put(left)
        self._call_at_next(left)
        return iter(())

    def close(self) -> None:
        pass

    def _call_at_next(self, newest: dict) -> None:
        closed = [v[0] for v in newest.values() if not v[3]]
        if closed:
            self.handle.registerTimer(min(closed) // 1000 + 1)


SIGNAL_DELAY = "7 days"


def open_changes(signals: DataFrame, delay: str = SIGNAL_DELAY) -> DataFrame:
    """Changes of the number of open signals over a stream of signal rows: only signals whose openness changes give a row.

    Rows may come up to ``delay`` after newer ones; the state holds the open signals and those of the last ``delay``.
    """
    at = F.col("created_ts").cast("timestamp")
    rows = signals.select(bucket("signal_id").alias("bucket"), "signal_id", at.alias("at"), F.unix_micros(at).alias("t"), F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("i"),
                          status_rank().cast("int").alias("r"), (F.col("status") == "OPEN").alias("open")).withWatermark("at", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(OpenChange(), "signal_id string, change int", "append", "EventTime")


def alert_row(changes: DataFrame, threshold: int = 0) -> DataFrame:
    """The alert as of all changes so far: (open_count, triggered, summary)."""
    one = changes.agg(F.coalesce(F.sum("change"), F.lit(0)).cast("bigint").alias("open_count"))
    return one.select("open_count", (F.col("open_count") > threshold).alias("triggered"),
                      F.format_string(ALERT_SUMMARY_FORMAT, F.col("open_count")).alias("summary"))


def stream_open_alert(spark: SparkSession, sf_dir: str, threshold: int = 0) -> DataFrame:
    """I8: the open-signal alert from the changes each micro-batch brings."""
    totals = open_changes(_signal_stream(spark, sf_dir))
    return alert_row(run_to_parquet(totals, "alert", state_store=ROCKSDB), threshold)


def alert_sink(out: str, threshold: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the alert as of each micro-batch to its own folder below ``out``.

    The count of batch n is that of batch n - 1 plus the batch's changes, so a trigger reads one
    small folder however long the stream has run, and a retried batch writes the same row again.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        change = batch.select(F.col("change").cast("bigint").alias("change"))
        if epoch:
            before = batch.sparkSession.read.schema("open_count bigint").parquet(f"{out}/{EPOCH}={epoch - 1}")
            change = change.unionByName(before.select(F.col("open_count").alias("change")))
        alert_row(change, threshold).write.mode("overwrite").parquet(f"{out}/{EPOCH}={epoch}")
    return sink


def start_open_alert(signals_stream: DataFrame, out_path: str, checkpoint: str, threshold: int = 0,
                     every: str = "5 minutes", delay: str = SIGNAL_DELAY):
    """I8, live form: evaluate the open-signal alert on a processing-time trigger.

    ``signals_stream`` is a streaming frame of signal-log rows.  Each trigger writes the alert
    (open_count, triggered, summary) below ``<out_path>/alerts``, one folder per batch; all but the
    newest may be removed by retention rules.  Returns the running ``StreamingQuery``.
    """
    spark = signals_stream.sparkSession
    store = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return (open_changes(signals_stream, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                .foreachBatch(alert_sink(f"{out_path}/alerts", threshold)).trigger(processingTime=every).start())
    finally:
        spark.conf.set(STATE_STORE, store)


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_conf(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        return run
    return {
        "stream_silver": wrap(stream_silver),
        "stream_daily_activity": wrap(stream_daily_activity),
        "stream_inventory": wrap(stream_inventory),
        "stream_usage_rate": wrap(stream_usage_rate),
        "stream_debounce": wrap(stream_debounce),
        "stream_signal_lifecycle": wrap(stream_signal_lifecycle),
        "stream_latest_signals": wrap(stream_latest_signals),
        "stream_open_alert": wrap(stream_open_alert),
        "stream_dedupe": wrap(stream_dedupe),
        "stream_late_rows": wrap(stream_late_rows),
    }
