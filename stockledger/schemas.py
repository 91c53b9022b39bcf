"""Explicit schemas of the two logs and the auxiliary inputs (version 2 of the signal log)."""

from pyspark.sql import types as T

SCAN_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("station_id", T.StringType(), False),
    T.StructField("barcode_raw", T.StringType(), False),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("qty", T.IntegerType(), False),
    T.StructField("user_email", T.StringType(), True),
])

SIGNALS = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("signal_id", T.StringType(), False),
    T.StructField("created_ts", T.TimestampNTZType(), False),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("triggered_at_qty", T.LongType(), False),
    T.StructField("reorder_point", T.IntegerType(), False),
    T.StructField("reorder_qty", T.IntegerType(), False),
    T.StructField("trigger_event_id", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
])

# version 1 of the signal log: signal_id is the key, current_qty instead of triggered_at_qty
SIGNALS_V1 = T.StructType([
    T.StructField("signal_id", T.StringType(), False),
    T.StructField("created_ts", T.TimestampNTZType(), False),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("current_qty", T.LongType(), False),
    T.StructField("reorder_point", T.IntegerType(), False),
    T.StructField("reorder_qty", T.IntegerType(), False),
    T.StructField("trigger_event_id", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
])

RAW_SCANS = T.StructType([
    T.StructField("scan_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("station_id", T.StringType(), False),
    T.StructField("barcode_raw", T.StringType(), True),
    T.StructField("user_email", T.StringType(), True),
])

ACK_COMMANDS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("item_id", T.StringType(), False),
])

SLIP_LINE = T.StructType([
    T.StructField("item_id", T.StringType(), True),
    T.StructField("qty", T.IntegerType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
])
