"""Operator 13 [native]: exact duplicates with a heavy-hitter split.

1. ``digests``: one pass over the texts writes a narrow table (id, code points, SHA-256 of the text
   without ASCII white space, row number); every later step reads this table, never the texts.
2. ``frequent``: Misra-Gries counters over the digests (Spark's frequent-items sketch: a bounded
   counter map, all counters lowered when it is full).  Every group of files has a sketch, and sketches
   are combined in two levels, so no task merges more than a bounded number of them.
3. ``verified``: one exact, map-side reduced count of the candidates; those with more than one in
   ``counters`` rows are winners.  A sketch of ``TRACKED`` times as many counters never misses such a
   digest, so any digest left over holds at most one row in ``counters``.
4. Winners (at most ``counters`` rows of some 120 bytes) are broadcast: their rows get their group's
   row at the map side and are not shuffled.
5. The other digests use ordinary shuffling: a partial aggregate per digest, joined back.  Only
   digests with several rows are joined; AQE splits a partition that is still too large.

Of equal texts the row with the most code points in the original text stays, then the smallest id
(null ids last), then the first row in the stored table, so one row of a group stays even where
rows repeat whole.

Cases: null, empty and blank texts are one group (digest of the empty text); texts are read whole; an
empty table gives no rows; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import ASCII_SPACE, read, stored

COUNTERS = 1024    # winners at most; a digest with more than 1 in COUNTERS rows always wins
TRACKED = 8        # tracked items per counter: keeps the sketch's error below half of that share
FAN_IN = 64        # groups of partitions whose sketches are combined first


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, "")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, points, sha, row): stored once; ``row`` numbers the rows of the stored table."""
    text = F.col(text_col)
    return stored(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.length(text.cast("string")), F.lit(0)).alias("points"),
        F.sha2(normalised(text).cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")


def frequent(each: DataFrame, *, counters: int = COUNTERS) -> DataFrame:
    """(sha): candidates, at most ``counters``; every digest with more than one in ``counters`` rows is among them."""
    tracked = counters * TRACKED
    part = each.select("sha", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("g")) \
        .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(sha, {tracked})").alias("s"))
    # grouped by a constant: without rows there is no sketch to combine
    whole = part.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {counters})")).alias("c")).select(F.col("c.item").alias("sha"))


def _best(each: DataFrame) -> DataFrame:
    """(sha, group_size, best): rows of each digest and the one that stays, partially aggregated before the shuffle."""
    rank = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    return each.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))


def verified(each: DataFrame, candidates: DataFrame, *, counters: int = COUNTERS) -> DataFrame:
    """(sha, group_size, best) of the candidates that hold more than one in ``counters`` rows."""
    rows = each.agg(F.count(F.lit(1)).alias("n")).scalar()
    exact = _best(each.join(F.broadcast(candidates), "sha", "left_semi"))
    return stored(exact.where((F.col("group_size") > 1) & (F.col("group_size") * counters > rows)), "winners")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) for every row of ``docs``."""
    each = digests(docs, id_col=id_col, text_col=text_col)
    winners = verified(each, frequent(each, counters=counters), counters=counters)
    heavy = each.join(F.broadcast(winners), "sha")
    rest = each.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    several = _best(rest).where("group_size > 1")
    light = rest.join(several, "sha", "left")

    def result(rows: DataFrame) -> DataFrame:
        alone = F.col("group_size").isNull()
        return rows.select("id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                           F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                           (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "sha")

    return result(heavy).unionByName(result(light))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document."""
    out = deduplicate(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id NULLS LAST)
"""
