"""Bridges from the given test tables to the two logical logs.

The rules are those stated in FIXTURES.md section 3; every bridge is a
projection of one scan (no shuffle), so it scales with its input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scans_from_events(events: DataFrame, *extra: str) -> DataFrame:
    """Bridge E: ``events`` -> scan log (bronze; ERROR rows and qty 0 kept), with ``extra`` source columns."""
    et = F.col("event_type")
    item = F.concat(F.lit("PART-"), F.col("user_id").cast("string"))
    qty = F.floor(F.col("value") / 4).cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_ts"),
        F.when(et.isin("signup", "view"), F.lit("INTAKE"))
         .when(et.isin("purchase", "click"), F.lit("CONSUME"))
         .otherwise(F.upper(et)).alias("event_type"),
        F.concat(F.lit("ST-"), (F.col("event_id") % 5).cast("string")).alias("station_id"),
        F.concat(F.lit("ITEM="), item, F.lit(";QTY="), qty.cast("string")).alias("barcode_raw"),
        item.alias("item_id"),
        qty.alias("qty"),
        F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")))
         .alias("user_email"),
        *extra,
    )


def scans_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Bridge L: ``lineitem`` -> a larger scan log (no acknowledgements)."""
    qty = F.col("l_quantity").cast("int")
    item = F.concat(F.lit("PART-"), F.col("l_partkey").cast("string"))
    eid = F.md5(F.concat_ws("|", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                            F.col("l_suppkey"), qty,
                            F.round(F.col("l_extendedprice") * 100).cast("bigint")))
    offset = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 86400
    ts = F.col("l_shipdate") + F.make_dt_interval(secs=offset.cast("int"))
    return lineitem.select(
        eid.alias("event_id"),
        ts.cast("timestamp_ntz").alias("event_ts"),
        F.when(F.col("l_linestatus") == "O", F.lit("INTAKE")).otherwise(F.lit("CONSUME")).alias("event_type"),
        F.concat(F.lit("SUP-"), F.col("l_suppkey").cast("string")).alias("station_id"),
        F.concat(F.lit("ITEM="), item, F.lit(";QTY="), qty.cast("string")).alias("barcode_raw"),
        item.alias("item_id"),
        qty.alias("qty"),
        F.lit(None).cast("string").alias("user_email"),
    )


def acks_from_scans(bronze_scans: DataFrame) -> DataFrame:
    """Bridge A: every ERROR row acknowledges the open signal of its item, if any."""
    return (bronze_scans.filter(F.col("event_type") == "ERROR")
            .select("event_id", "event_ts", "item_id"))


def rescans(bronze_scans: DataFrame, *extra: str) -> DataFrame:
    """Bridge R: rows with ``event_id % 4 = 0`` repeated at offsets 0, 2, 4 and 7 seconds."""
    rep = (bronze_scans.filter(F.col("event_id").cast("bigint") % 4 == 0)
           .withColumn("off", F.explode(F.array(*[F.lit(x) for x in (0, 2, 4, 7)]))))
    rep = rep.select(
        F.concat(F.col("event_id"), F.lit("#"), F.col("off").cast("string")).alias("event_id"),
        (F.col("event_ts") + F.make_dt_interval(secs=F.col("off"))).alias("event_ts"),
        "event_type", "station_id", "barcode_raw", "item_id", "qty", "user_email", *extra)
    rest = bronze_scans.filter(F.col("event_id").cast("bigint") % 4 != 0)
    return rest.unionByName(rep)


def raw_scans_from_scans(scans: DataFrame, *extra: str) -> DataFrame:
    """The ingest input shape (scan id, time, kind, station, raw text, user)."""
    return scans.select(
        F.col("event_id").alias("scan_id"), "event_ts",
        F.col("event_type").alias("kind"), "station_id", "barcode_raw", "user_email", *extra)


def bridge_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_from_events(read_table(spark, sf_dir, "events"))


def bridge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def with_hot_key(scans: DataFrame, source_id, every: int = 3) -> DataFrame:
    """Skew case: every ``every``-th row (by the numeric ``source_id``) moves to one hot
    item and one hot barcode, so one key holds a third of the rows.  All rows are
    kept; only their key changes."""
    staged = scans.withColumn("__hot", source_id % every == 0)
    hot = F.col("__hot")
    return staged.withColumns({
        "item_id": F.when(hot, F.lit("PART-HOT")).otherwise(F.col("item_id")),
        "barcode_raw": F.when(hot, F.concat(F.lit("ITEM=PART-HOT;QTY="), F.col("qty").cast("string")))
        .otherwise(F.col("barcode_raw")),
    }).drop("__hot")


def numeric_source_id():
    """Source event number of bridge E / R ids (``<n>`` or ``<n>#<offset>``)."""
    return F.substring_index(F.col("event_id"), "#", 1).cast("bigint")


def hex_source_id():
    """First 32 bits of a bridge L id (an md5 digest) as a number."""
    return F.conv(F.substring(F.col("event_id"), 1, 8), 16, 10).cast("bigint")
