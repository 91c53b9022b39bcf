"""Raw scans -> ledger rows and rejects; bulk intake from slip lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockledger.config import DEFAULT, Params
from stockledger.functions.barcode import make_barcode, parse_barcode_cols
from stockledger.operators.debounce import debounce
from stockledger.operators.ordered import stored


def ingest_scans(raw: DataFrame, params: Params = DEFAULT, default_ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Debounce on the raw text (before parsing, across stations and kinds),
    then parse.  Returns (ledger rows, rejects with reason): every scan is in one of them.

    raw: scan_id, event_ts, kind (INTAKE/CONSUME), station_id, barcode_raw, user_email.
    A missing time becomes ``default_ts`` before the debounce (pass the time of
    receipt, as the log's own default does); without it the scan is rejected as no_time.
    """
    if default_ts is not None:
        raw = raw.withColumn("event_ts", F.coalesce(F.col("event_ts"), default_ts.cast(raw.schema["event_ts"].dataType)))
    flagged = debounce(raw, keys=["barcode_raw"], params=params, id_col="scan_id", with_flag=True)
    item, qty, err = parse_barcode_cols(F.col("barcode_raw"))
    staged = flagged.withColumns({"__item": item, "__qty": qty, "__err": err})
    reason = (F.when(F.col("event_ts").isNull(), F.lit("no_time")).when(~F.col("kept"), F.lit("duplicate"))
              .otherwise(F.col("__err")))
    # kept once: ledger rows and rejects are both read from it
    staged = stored(staged.withColumn("reason", reason), "ingested")
    ledger = staged.filter(F.col("reason").isNull()).select(
        F.col("scan_id").alias("event_id"), "event_ts", F.col("kind").alias("event_type"), "station_id",
        "barcode_raw", F.col("__item").alias("item_id"), F.col("__qty").alias("qty"), "user_email")
    rejects = staged.filter(F.col("reason").isNotNull()).select(
        "scan_id", "event_ts", "kind", "station_id", "barcode_raw", "reason")
    return ledger, rejects


def append_scans(rows: DataFrame, path: str, batch_id: str | None = None) -> str:
    """A5: append ledger rows (id and time defaulted when absent) to the scan log at ``path``, each event once.

    Rows without an id get a random one; only a ``batch_id`` makes a retry of those harmless.
    """
    from stockledger.sources.sinks import append_once
    cols = rows.columns
    out = rows
    if "event_id" not in cols:
        out = out.withColumn("event_id", F.expr("uuid()"))
    if "event_ts" in cols:
        out = out.withColumn("event_ts", F.coalesce(F.col("event_ts"), F.localtimestamp()))
    else:
        out = out.withColumn("event_ts", F.localtimestamp())
    return append_once(out, path, ["event_id"], "event_ts", batch_id)


def bulk_intake(slip_lines: DataFrame, params: Params = DEFAULT, dedupe: bool = True,
                station_id: str = "PACKING_SLIP") -> tuple[DataFrame, DataFrame]:
    """H9: slip lines -> synthetic barcodes -> parse -> (debounce) -> INTAKE rows.

    slip_lines: slip_id, line_no, item_id, qty, received_ts, and the caller's user_email
    if known.  Lines of one slip
    share the instant, so equal (item, qty) lines of a slip collapse to one, as
    the modelled service does; ``dedupe=False`` keeps them all.
    """
    raw = slip_lines.select(
        F.concat_ws("-", F.col("slip_id").cast("string"), F.col("line_no").cast("string")).alias("scan_id"),
        F.col("received_ts").alias("event_ts"), F.lit("INTAKE").alias("kind"),
        F.lit(station_id).alias("station_id"),
        make_barcode(F.col("item_id"), F.col("qty")).alias("barcode_raw"),
        (F.col("user_email") if "user_email" in slip_lines.columns else F.lit(None).cast("string")).alias("user_email"))
    if dedupe:
        # kept first: the debounce reads its input twice, and reading slips is the dearer part
        return ingest_scans(stored(raw, "bulk-scans"), params)
    item, qty, err = parse_barcode_cols(F.col("barcode_raw"))
    staged = raw.withColumns({"__item": item, "__qty": qty, "reason": err})
    ledger = staged.filter(F.col("reason").isNull()).select(
        F.col("scan_id").alias("event_id"), "event_ts", F.col("kind").alias("event_type"), "station_id",
        "barcode_raw", F.col("__item").alias("item_id"), F.col("__qty").alias("qty"), "user_email")
    rejects = staged.filter(F.col("reason").isNotNull()).select(
        "scan_id", "event_ts", "kind", "station_id", "barcode_raw", "reason")
    return ledger, rejects
