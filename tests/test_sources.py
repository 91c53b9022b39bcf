"""File source (A7), sinks (A4-A6) and the schema migration."""

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as E
from stockledger.functions import slips
from stockledger.functions.slips import load_slip_files
from stockledger.plans import medallion as M
from stockledger.session import scratch_path
from stockledger.sources import bridge, files, sinks, slipdata, tables

SF = "/root/testdata/sf0.001"


def test_load_slip_files(spark):
    d = tempfile.mkdtemp(prefix="slips-")
    for name, size in [("a.png", 10), ("b.PDF", 20), ("c.txt", 5), ("d.jpeg", 30), ("e.Jpg", 3), ("f.tif", 4), ("g", 5)]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"x" * size)
    files, rejects = load_slip_files(spark, d, max_bytes=25)
    assert {os.path.basename(r.path): r.media_type for r in files.collect()} == {
        "a.png": "image/png", "b.PDF": "application/pdf", "e.Jpg": "image/jpeg", "f.tif": "image/jpeg"}
    assert {os.path.basename(r.path): r.reason for r in rejects.collect()} == {
        "c.txt": "not_an_image_or_pdf", "d.jpeg": "too_large", "g": "not_an_image_or_pdf"}


def test_migrate_v1_to_v2(spark):
    v1 = spark.createDataFrame(
        [("s", "2024-01-01 00:00:00", "X", 3, 10, 24, "e", "OPEN"),
         ("s", "2024-01-01 00:01:00", "X", 3, 10, 24, "e", "FULFILLED")],
        "signal_id string, created_ts string, item_id string, current_qty bigint, reorder_point int, "
        "reorder_qty int, trigger_event_id string, status string").withColumn(
        "created_ts", F.col("created_ts").cast("timestamp_ntz"))
    v2 = sinks.migrate_signals_v1_to_v2(v1)
    assert "triggered_at_qty" in v2.columns
    assert sorted((r.status, r.id) for r in v2.collect()) == [("FULFILLED", 2), ("OPEN", 1)]
    assert sinks.migrate_signals_v1_to_v2(v2) is v2


def _inputs(spark):
    q = E.queries()
    return bridge.bridge_e(spark, SF), q["bronze_replenishment_signals"](spark, SF)


def test_failed_refresh_leaves_the_published_layers(spark, monkeypatch):
    bronze, signals = _inputs(spark)
    target, database = scratch_path(spark, "atomic"), "atomic_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {database}")
    assert sinks.published(spark, target) == {}
    M.refresh(spark, bronze, signals, target, database=database)
    before = sinks.published(spark, target)
    rows = {n: spark.read.parquet(p).count() for n, p in before.items()}
    assert set(M.QUALITY) < set(before) and rows["bronze_scan_events"] == bronze.count()

    def fails(*_):
        raise RuntimeError("half way")
    monkeypatch.setitem(M.LAYERS, "gold_daily_activity", (fails, ["silver_scan_events"]))
    with pytest.raises(RuntimeError):
        M.refresh(spark, bronze.limit(10), signals.limit(3), target, database=database)
    assert sinks.published(spark, target) == before
    assert {n: spark.read.parquet(p).count() for n, p in before.items()} == rows
    assert all(spark.table(f"{database}.{n}").count() == rows[n] for n in M.QUALITY)

    monkeypatch.undo()
    M.refresh(spark, bronze.limit(10), signals.limit(3), target, database=database)
    after = sinks.published(spark, target)
    assert not set(after.values()) & set(before.values())
    assert spark.table(f"{database}.bronze_scan_events").count() == 10 == spark.read.parquet(after["bronze_scan_events"]).count()


def test_refresh_counts_rule_failures_while_writing(spark):
    from stockledger.operators import quality
    bronze, signals = _inputs(spark)
    target = scratch_path(spark, "observed")
    M.refresh(spark, bronze, signals, target)
    got = {tuple(r) for r in spark.read.parquet(sinks.published(spark, target)["expectations"]).collect()}
    want = {("silver_scan_events", *r) for r in quality.expectation_metrics(bronze, quality.SCAN_RULES).collect()}
    want |= {("silver_replenishment_signals", *r) for r in quality.expectation_metrics(signals, quality.SIGNAL_RULES).collect()}
    assert got == want


def test_layer_and_counts_come_from_one_read_of_the_log(spark, monkeypatch):
    """The scan of the log runs in one job: that of the write."""
    path = scratch_path(spark, "log")
    bridge.bridge_e(spark, SF).write.parquet(path)
    log = spark.read.parquet(path)
    monkeypatch.setattr(M, "expectation_metrics", lambda *_: pytest.fail("counted in a pass of its own"))
    out, counts = M.write_layer(spark, "silver_scan_events", [log], scratch_path(spark, "one-read"))
    assert spark.read.parquet(out).count() == M.silver_scan_events(log).count() and len(counts) == 3


def test_miscounted_expectations_are_counted_again(spark, monkeypatch):
    from stockledger.operators import quality
    log = bridge.bridge_e(spark, SF)
    monkeypatch.setattr(quality.Expectations, "kept", property(lambda self: -1))
    _, counts = M.write_layer(spark, "silver_scan_events", [log], scratch_path(spark, "recount"))
    assert sorted(counts) == sorted(tuple(r) for r in quality.expectation_metrics(log, quality.SCAN_RULES).collect())


def test_appends_are_idempotent(spark):
    from stockledger.operators import ingest
    ddl = "event_id string, event_ts timestamp_ntz, event_type string, station_id string, barcode_raw string, item_id string, qty int, user_email string"
    t = lambda d: dt.datetime(2024, 1, d)
    row = lambda i, d: (i, t(d), "INTAKE", "s", "b", "p", 1, None)
    rows = lambda *r: spark.createDataFrame(list(r), ddl)
    ids = lambda p: sorted(r.event_id for r in tables.bronze_scan_events(spark, p).collect())
    path = scratch_path(spark, "idempotent")
    ingest.append_scans(rows(row("a", 1), row("b", 2)), path, "one")
    ingest.append_scans(rows(row("a", 1), row("b", 2)), path, "one")          # a retry
    assert ids(path) == ["a", "b"]
    ingest.append_scans(rows(row("b", 2), row("c", 3), row("c", 3)), path)    # delivered again, without a name
    ingest.append_scans(rows(), path, "empty")
    assert ids(path) == ["a", "b", "c"]
    # without an id a row gets one; the batch's name makes its retry harmless
    untold = rows(row(None, 4), row(None, 5)).drop("event_id", "event_ts")
    for _ in range(2):
        ingest.append_scans(untold, path, "untold")
    assert len(ids(path)) == 5
    signal = "id bigint, signal_id string, created_ts timestamp_ntz, item_id string, triggered_at_qty bigint, reorder_point int, reorder_qty int, trigger_event_id string, status string"
    log = scratch_path(spark, "idempotent-signals")
    sig = spark.createDataFrame([(None, "s", t(1), "p", 1, 10, 24, None, "OPEN"), (None, "s", t(1), "p", 1, 10, 24, None, "FULFILLED")], signal)
    for batch in ("x", "x", None, None):
        sinks.append_signals(sig, log, batch)
    assert sorted(r.status for r in tables.bronze_replenishment_signals(spark, log).collect()) == ["FULFILLED", "OPEN"]


def test_slip_files_are_written_again_by_a_retry(spark):
    root = scratch_path(spark, "slip-files")
    files = spark.createDataFrame([("a.png", bytearray(b"x")), ("b.txt", bytearray(b"yy"))], "name string, content binary")
    for _ in range(2):
        assert slipdata.write_files(files.repartition(2), root) == 2
    got = spark.read.format("binaryFile").load(root).collect()
    assert sorted((os.path.basename(r.path), bytes(r.content)) for r in got) == [("a.png", b"x"), ("b.txt", b"yy")]


def test_many_slip_files_take_few_tasks(spark):
    """The tasks of a read follow the cores, not the files; files without a name are written too."""
    root = tempfile.mkdtemp(prefix="slips-") + "/in"
    names = [f"s{i}.png" for i in range(2000)] + [None]
    files = spark.createDataFrame([(n, b"x") for n in names], "name string, content binary")
    assert slipdata.write_files(files, root) == 2001
    ok, rejects = load_slip_files(spark, root)
    most = slips.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert ok.rdd.getNumPartitions() <= most < 2001 // 32 and rejects.rdd.getNumPartitions() <= most
    assert ok.count() == 2000 and [r.path.rsplit("/", 1)[1] for r in rejects.collect()] == ["None"]


def test_driver_holds_no_slip_files(spark):
    """The files are listed and read by tasks: neither result keeps their names on the driver."""
    root = scratch_path(spark, "slip-files")
    sent = spark.createDataFrame([(f"s{i}.{'png' if i % 2 else 'txt'}", b"%d" % i) for i in range(400)], "name string, content binary")
    assert slipdata.write_files(sent, root) == 400
    ok, rejects = load_slip_files(spark, root)
    assert {os.path.basename(p)[0] for x in (ok, rejects) for p in x.inputFiles()} == {"p"}     # parts of the listing
    assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in ok.collect()} == {f"s{i}.png": b"%d" % i for i in range(1, 400, 2)}
    assert rejects.count() == 200


def _odd_tree() -> str:
    root = tempfile.mkdtemp(prefix="slip files %20#-")
    for name, content in {
            "a b.png": b"1", "p%20q?.png": b"22", "ä.pdf": b"333", "no ending": b"4", "empty.png": b"", "_hidden.png": b"5", "_k=1.png": b"6", ".dot.png": b"7",
            "half.png._COPYING_": b"8", "_metadata.png": b"9", "squeezed.gz": b"plain", "large.png": b"x" * (9 << 20), "deep/er/est/of/all/z.jpg": b"a",
            "_out/b.png": b"b", ".git/c.png": b"c", "_metadata/d.png": b"d", "k=1/e.png": b"e", "_k=2/f.png": b"f", "void/.keep": b"g"}.items():
        os.makedirs(os.path.dirname(at := os.path.join(root, name)), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content)
        os.utime(at, ns=(10**18, 1_500_000_000_123_987_654))
    os.symlink(f"{root}/deep", f"{root}/linked")
    os.symlink(f"{root}/gone", f"{root}/dangling.png")
    return root


@pytest.mark.parametrize("tasks", [1, 3, 100])
@pytest.mark.parametrize("below", ["", "/", "/deep", "/a b.png", "/_hidden.png", "/empty.png", "/{deep,deep/er,k=1,*.png}", "/*"])
def test_files_are_listed_as_sparks_reader_lists_them(spark, below, tasks):
    root = _odd_tree()
    if below and not below.endswith("/"):       # Spark takes these as patterns
        os.rename(root, root := root.replace("%20#", "x"))
    with open(os.fsencode(root) + b"/no utf-8 \xff.png", "wb") as f:
        f.write(b"1")
    path = root + below
    store = files.opened(spark, path)
    listing = files.listed(spark, store, tasks)
    got = files.with_content(listing, store, tasks)
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(*got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.rdd.getNumPartitions() == tasks


def test_other_stores_list_a_folder_at_once():
    root = _odd_tree()
    rows = lambda s, p: sorted((e[0].removeprefix(p).strip("/"), *e[1:]) for e in files.entries(s, p) if not e[1])
    local = fs.LocalFileSystem()
    assert rows(fs.SubTreeFileSystem(root, local), "") == rows(local, root) != []


def test_files_of_a_store_that_only_hadoop_reaches(spark):
    root = tempfile.mkdtemp(prefix="slips-")
    for name in ("a.png", "b.txt"):
        with open(f"{root}/{name}", "wb") as f:
            f.write(b"x")
    spark.conf.set("fs.viewfs.mounttable.store.link./in", f"file://{root}")
    ok, rejects = load_slip_files(spark, "viewfs://store/in")
    assert [(r.path, r.media_type, bytes(r.content)) for r in ok.collect()] == [("viewfs://store/in/a.png", "image/png", b"x")]
    assert [(r.path, r.reason) for r in rejects.collect()] == [("viewfs://store/in/b.txt", "not_an_image_or_pdf")]
    spark.conf.unset("fs.viewfs.mounttable.store.link./in")


def test_missing_folder_of_slip_files(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_slip_files(spark, tempfile.mkdtemp(prefix="slips-") + "/none")
