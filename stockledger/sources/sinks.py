"""Layer writes, append-only sinks, views and the signal-log migration."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockledger.config import DEFAULT, Params
from stockledger.operators.latest import latest_signals, status_rank
from stockledger.operators.ledger import all_inventory
from stockledger.operators.ordered import join_on_keys, ordered_scan, with_cells


def materialize(df: DataFrame, target: str, name: str, quality: str,
                partition_by: list[str] | None = None, version: str | None = None) -> str:
    """A4: write of one layer to ``<target>/<quality>/<name>``, or to a folder of its own below it for a ``version``.

    The quality tier (bronze / silver / gold) is a folder level, so readers
    and retention rules can select a tier by path.
    """
    path = f"{target.rstrip('/')}/{quality}/{name}" + (f"/{version}" if version else "")
    if partition_by:
        # rebalance: AQE groups rows by the partition columns, splitting a hot
        # value (one busy day) over several tasks and merging small ones, so the
        # write makes few files per folder without one task per value
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


_VERSIONS = "layer string, quality string, path string"


def _newest_version(spark: SparkSession, target: str) -> tuple[int, DataFrame | None]:
    try:
        log = spark.read.schema(f"{_VERSIONS}, n int").parquet(f"{target.rstrip('/')}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    n = log.agg(F.max("n").alias("n")).first()["n"]
    return n or 0, None if n is None else log.filter(F.col("n") == n)


def publish(spark: SparkSession, target: str, layers: list[tuple[str, str, str]]) -> int:
    """A4: make a set of written layers (name, quality, path) the current ones, all at once.

    The set is one small file in a numbered folder, which appears complete or not at all; readers
    take the highest number.  Of two refreshes that end together one fails here and changes nothing.
    """
    n = _newest_version(spark, target)[0] + 1
    spark.createDataFrame(layers, _VERSIONS).coalesce(1).write.parquet(f"{target.rstrip('/')}/versions/n={n}")
    return n


def published(spark: SparkSession, target: str) -> dict[str, str]:
    """A4: layer -> path of the newest published set; empty before the first."""
    _, rows = _newest_version(spark, target)
    return {} if rows is None else {r["layer"]: r["path"] for r in rows.collect()}


def register_layer(spark: SparkSession, database: str, name: str, path: str, quality: str, comment: str) -> None:
    """A4: a catalog view of a written layer, with its comment and ``quality`` property; a later version replaces it in one step."""
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} COMMENT '{comment}' TBLPROPERTIES ('quality' = '{quality}') AS SELECT * FROM parquet.`{path}`")


def append_once(rows: DataFrame, path: str, keys: list[str], ts_col: str, batch_id: str | None = None) -> str:
    """Append rows to the log at ``path`` so that each key is there once, however often they are delivered.

    Every batch has a folder of its own, ``batch=<batch_id>``: a batch that is written again replaces
    itself.  Rows whose key another batch has brought before are left out; only the part of the log
    between the batch's first and last time is compared (a key always has the same time), by
    columns of the key alone.  ``read_log`` gives the rows back.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    batch = batch_id or uuid.uuid4().hex
    names = list(dict.fromkeys([*keys, ts_col]))
    # a first folder without rows: the log exists, and has its schema, from here on
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/batch=0000")
    ends = rows.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    inside = F.col(ts_col).isNull()
    if ends["lo"] is not None:
        inside = inside | F.col(ts_col).between(F.lit(ends["lo"]).cast(rows.schema[ts_col].dataType), F.lit(ends["hi"]).cast(rows.schema[ts_col].dataType))
    others = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.StringType())])).parquet(path) \
        .filter((F.col("batch") != batch) & inside).select(*names)
    new = join_on_keys(rows, others.select(*keys), keys, "left_anti").dropDuplicates(keys)
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return path


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a log written by ``append_once``."""
    return spark.read.schema(schema).parquet(path.rstrip("/")).select(*schema.fieldNames())


SIGNAL_KEY = ["signal_id", "status", "created_ts", "id", "trigger_event_id"]


def append_signals(rows: DataFrame, path: str, batch_id: str | None = None) -> str:
    """Signal rows are only ever appended, each of them once."""
    return append_once(rows, path, SIGNAL_KEY, "created_ts", batch_id)


def register_views(spark: SparkSession, scans: DataFrame, signals: DataFrame) -> None:
    """``inventory_current`` and ``signals_current`` as temporary views."""
    all_inventory(scans, None).createOrReplaceTempView("inventory_current")
    latest_signals(signals).createOrReplaceTempView("signals_current")


def migrate_signals_v1_to_v2(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Version 1 -> 2 of the signal log; a no-op on a version-2 frame.

    ``current_qty`` becomes ``triggered_at_qty`` and ``id`` is added as the
    row's number within its signal (created_ts, status order) -- a per-key
    ordered count, never a global serial (which would be one sorted partition).
    """
    if "triggered_at_qty" in df.columns and "id" in df.columns:
        return df
    out = df
    if "current_qty" in out.columns:
        out = out.withColumnRenamed("current_qty", "triggered_at_qty")
    if "id" not in out.columns:
        out = out.withColumn("__rk", status_rank())
        order = ["created_ts", "__rk"]
        out = ordered_scan(with_cells(out, ["signal_id"], order, params.scan_cell_rows), ["signal_id"], order, sums={"id": F.lit(1).cast("bigint")})
    return out.select("id", "signal_id", "created_ts", "item_id", "triggered_at_qty", "reorder_point",
                      "reorder_qty", "trigger_event_id", "status")


def migrate_scans_add_user_email(df: DataFrame) -> DataFrame:
    """A9 (scan log part): add the nullable ``user_email`` column when missing."""
    return df if "user_email" in df.columns else df.withColumn("user_email", F.lit(None).cast("string"))
