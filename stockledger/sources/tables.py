"""A1-A3: reading the two logs from a catalog, Parquet files or an operational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockledger.schemas import SCAN_EVENTS, SIGNALS


def _source(spark: SparkSession, table: str) -> str:
    catalog = spark.conf.get("pipeline.source_catalog", None)
    schema = spark.conf.get("pipeline.source_schema", None)
    parts = [p for p in (catalog, schema) if p]
    return ".".join(parts + [table])


def bronze_scan_events(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A1: unmodified scan log -- a catalog table (catalog/schema from conf) or Parquet with the fixed schema."""
    if path is not None:
        return spark.read.schema(SCAN_EVENTS).parquet(path).select(*SCAN_EVENTS.fieldNames())
    return spark.table(_source(spark, "scan_events"))


def bronze_replenishment_signals(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A2: unmodified signal log."""
    if path is not None:
        return spark.read.schema(SIGNALS).parquet(path).select(*SIGNALS.fieldNames())
    return spark.table(_source(spark, "replenishment_signals"))


def read_operational_table(spark: SparkSession, url: str, table: str, partition_column: str,
                           lower_bound, upper_bound, num_partitions: int,
                           properties: dict | None = None) -> DataFrame:
    """A3: parallel read from the operational database over JDBC.

    The read is split into ``num_partitions`` range queries on
    ``partition_column`` so each executor pulls one slice.  Needs the
    database's JDBC driver on the classpath (not present in the test image).
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                           upperBound=upper_bound, numPartitions=num_partitions,
                           properties=properties or {})
