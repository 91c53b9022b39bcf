"""Data-quality rules: expect-or-drop, per-rule metrics, quarantine, integrity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# fixed rule sets of the medallion layers (name -> SQL predicate)
SCAN_RULES = {
    "valid_event_type": "event_type IN ('INTAKE', 'CONSUME')",
    "valid_qty": "qty > 0",
    "valid_item_id": "item_id IS NOT NULL AND LENGTH(item_id) > 0",
}
SIGNAL_RULES = {
    "valid_status": "status IN ('OPEN', 'ACKNOWLEDGED', 'FULFILLED')",
}


def _pred(p: str | Column) -> Column:
    """A rule that evaluates to NULL counts as failed."""
    c = F.expr(p) if isinstance(p, str) else p
    return F.coalesce(c, F.lit(False))


def expect_or_drop(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """Keep rows for which every rule is TRUE.

    A filter already drops rows whose condition is NULL, so the rules are used
    bare: that keeps them simple comparisons the Parquet reader can push down.
    """
    out = df
    for p in rules.values():
        out = out.filter(F.expr(p) if isinstance(p, str) else p)
    return out


def _counts(rules: dict[str, str | Column]) -> list[Column]:
    aggs = []
    for name, p in rules.items():
        ok = _pred(p)
        aggs += [F.count_if(ok).alias(f"p_{name}"), F.count_if(~ok).alias(f"f_{name}")]
    return aggs


def expectation_metrics(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """Passed / failed record counts per rule in one pass over the data."""
    one = df.agg(*_counts(rules))
    rows = [F.struct(F.lit(name).alias("expectation_name"),
                     F.col(f"p_{name}").alias("passed_records"),
                     F.col(f"f_{name}").alias("failed_records")) for name in rules]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


class Expectations:
    """B4 without a pass of its own: the rules' counts are observed while the data passes on its way to a layer."""

    def __init__(self, rules: dict[str, str | Column]):
        self.rules, self._seen = rules, Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        """``df`` with its rows counted by whatever action reads it to the end; filters stay behind this point."""
        every = F.lit(True)
        for p in self.rules.values():
            every = every & _pred(p)
        return df.observe(self._seen, F.count_if(every).alias("kept"), *_counts(self.rules))

    @property
    def kept(self) -> int:
        """Rows that pass every rule."""
        return self._seen.get["kept"]

    def rows(self) -> list[tuple[str, int, int]]:
        """(rule, passed, failed) after the action."""
        got = self._seen.get
        return [(name, got[f"p_{name}"], got[f"f_{name}"]) for name in self.rules]


def quarantine(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """Rows failing at least one rule, with the array of failed rule names."""
    failed = F.array_compact(F.array(*[F.when(~_pred(p), F.lit(name)) for name, p in rules.items()]))
    return df.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)


def duplicate_event_ids(scans: DataFrame) -> DataFrame:
    """event_id values used more than once (the log's key must be unique)."""
    return (scans.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def check_violations(scans: DataFrame) -> DataFrame:
    """Rows breaking the log's CHECK rules, one row per (event, rule)."""
    return quarantine(scans, SCAN_RULES).select(
        "event_id", F.explode("failed_rules").alias("rule"))


def quality_event_log(df: DataFrame, rules: dict[str, str | Column], flow: str = "silver_scan_events",
                      at: Column | None = None) -> DataFrame:
    """One progress row per rule whose ``details`` is a JSON document (the shape of
    a pipeline's event log); ``at`` is the time of the run (default: now)."""
    m = expectation_metrics(df, rules)
    return m.select((F.localtimestamp() if at is None else at).alias("timestamp"), F.lit(flow).alias("flow_name"), F.lit("flow_progress").alias("event_type"),
                    F.to_json(F.struct("expectation_name", "passed_records", "failed_records")).alias("details"))


def expectation_log_query(log: DataFrame) -> DataFrame:
    """H6: JSON paths on the log's details -- time, rule name and counts of flow-progress rows."""
    d = F.col("details")
    return (log.filter((F.col("event_type") == "flow_progress")
                       & F.get_json_object(d, "$.expectation_name").isNotNull())
            .select("timestamp", F.get_json_object(d, "$.expectation_name").alias("expectation_name"),
                    F.get_json_object(d, "$.passed_records").cast("bigint").alias("passed_records"),
                    F.get_json_object(d, "$.failed_records").cast("bigint").alias("failed_records")))
