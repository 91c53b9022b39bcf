"""Operator 1 [native]: URL filters as a temporal list join.

Dated list entries (``add`` / ``remove`` of a pattern at a time) become validity intervals, and
an as-of join evaluates every capture against the entries active when it was fetched.

A pattern is a host suffix (``example.com`` covers its sub-hosts) or a host suffix with
leading path segments (``example.com/en``).  A capture's keys are all its host suffixes, each
with 0 .. ``depth`` leading path segments, where ``depth`` is the deepest pattern of the lists;
so the join is an equality on the key with the fetch time inside the interval.  The most
specific active pattern decides (longest; ties: allow before block, then list name).

Only built-in functions.  Intervals are broadcast when their measured size is at most
``broadcast_bytes``; beyond it the join shuffles by key, and AQE splits a hot host.  Equal
captures are counted once and repeated at the end; the rows a capture expands to are folded
again by partial aggregation before the only shuffle of the captures.

Cases: a null or unparsable url has no host and matches nothing; a null fetch time matches
nothing; a null id is kept; entries with a null pattern, action or time are ignored; of an add
and a remove at the same time the remove holds; repeated entries count once; repeated captures
each give a row; empty tables give no rows, or captures without matches.  Only the named
columns are read; others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockledger.llm.common import read, stored, table_bytes

BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null when there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.nullif(host, F.lit(""))


def segments_of(url: Column) -> Column:
    """Path segments, without query and fragment."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_remove(F.split(path, "/", -1), "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): when each pattern is on its list; open ends are null."""
    clean = entries.where("pattern is not null and action in ('add', 'remove') and effective is not null")
    # one state per instant; a remove wins over an add
    state = clean.groupBy("list", "kind", "pattern", "effective").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("effective")
    return (state.withColumn("valid_to", F.lead("effective").over(w)).where("action = 'add'")
            .select("list", "kind", "pattern", F.col("effective").alias("valid_from"), "valid_to"))


def keys_of(host: Column, segments: Column, depth: int) -> Column:
    """All host suffixes, each with 0 .. depth leading path segments."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    deep = F.least(F.size(segments), F.lit(depth))
    paths = F.transform(F.sequence(F.lit(0), deep), lambda n: F.when(n == 0, F.lit("")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))


def apply_lists(captures: DataFrame, entries: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, url, fetched, host, n_active, list, pattern, blocked) for every row of (id, url, fetched)."""
    spans = stored(intervals(entries), "intervals")
    depth = spans.agg(F.max(F.size(F.split("pattern", "/", -1)) - 1).alias("d")).first()["d"] or 0
    if table_bytes(spans, "list", "kind", "pattern") <= broadcast_bytes:
        spans = F.broadcast(spans)
    same = captures.select("id", "url", "fetched").groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
    own = same.withColumn("host", host_of(F.col("url")))
    wide = own.withColumn("key", F.explode_outer(F.when(F.col("host").isNotNull(), keys_of(F.col("host"), segments_of(F.col("url")), depth))))
    active = wide.join(spans, (wide["key"] == spans["pattern"]) & (wide["fetched"] >= spans["valid_from"])
                       & (spans["valid_to"].isNull() | (wide["fetched"] < spans["valid_to"])), "left")
    # longest pattern first, then allow, then the list's name: the smallest struct
    order = F.struct((-F.length("pattern")).alias("l"), (F.col("kind") != "allow").alias("b"), F.col("list").alias("list"),
                     F.col("pattern").alias("pattern"), F.col("kind").alias("kind"))
    best = active.groupBy("id", "url", "fetched", "host", "copies").agg(
        F.count("pattern").alias("n_active"), F.min(F.when(F.col("pattern").isNotNull(), order)).alias("best"))
    return best.select("id", "url", "fetched", "host", "n_active", F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"),
                       F.coalesce(F.col("best.kind") == "block", F.lit(False)).alias("blocked"),
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


# The pages table has no fetch times and no lists; both are derived from its rows by these rules.
FIRST_DAY, DAYS = "2024-01-01", 360


def digit(text: Column, n: int) -> Column:
    """A number below ``n`` from the text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long") % n


def day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("id"), "url",
                        day(digit(F.coalesce(F.col("page_id").cast("string"), F.lit("")), DAYS)).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts seen: blocked hosts (some removed and listed again), blocked
    parent domains, blocked first path segments, and allowed hosts."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.get(segments_of(F.col("url")), 0).alias("top")).where("host is not null").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    of = lambda name, kind, pattern, when, keep, *dates: hosts.where(keep).where(pattern.isNotNull()).select(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("action"), day(when + n).alias("effective")) for a, n in dates])).alias("e"))
    host, start = F.col("host"), digit(F.concat(F.lit("start"), "host"), 200)
    parts = [
        of("hosts", "block", host, start, digit(host, 4) == 0, ("add", 0), ("remove", 60), ("add", 90)),
        of("domains", "block", parent, digit(F.concat(F.lit("start"), parent), 200), digit(parent, 8) == 1, ("add", 0), ("remove", 120)),
        of("paths", "block", F.concat_ws("/", host, "top"), start, (digit(host, 3) == 1) & F.col("top").isNotNull(), ("add", 30)),
        of("trusted", "allow", host, start, digit(host, 16) == 4, ("add", 20), ("remove", 100)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("list", "kind", "pattern", "e.action", "e.effective").distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page at its fetch time."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = apply_lists(captures_of(pages), entries_of(pages))
    return out.select(F.col("id").alias("page_id"), "fetched", "host", "n_active", "list", "pattern", "blocked")


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, trim(url) AS url,
         nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
         list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg,
         DATE '2024-01-01' + CAST(CAST('0x' || md5(coalesce(CAST(page_id AS VARCHAR), ''))[1:6] AS BIGINT) % 360 AS INT) AS fetched
  FROM pages),
h AS (SELECT DISTINCT host, seg[1] AS top, regexp_replace(host, '^[^.]*\.', '') AS parent FROM p WHERE host IS NOT NULL),
n AS (
  SELECT *, CAST('0x' || md5(host)[1:6] AS BIGINT) AS hn, CAST('0x' || md5(parent)[1:6] AS BIGINT) AS pn,
         CAST('0x' || md5('start' || host)[1:6] AS BIGINT) % 200 AS hs, CAST('0x' || md5('start' || parent)[1:6] AS BIGINT) % 200 AS ps
  FROM h),
a AS (SELECT * FROM (VALUES ('hosts', 'add', 0), ('hosts', 'remove', 60), ('hosts', 'add', 90), ('domains', 'add', 0), ('domains', 'remove', 120),
                            ('paths', 'add', 30), ('trusted', 'add', 20), ('trusted', 'remove', 100)) v(list, action, plus)),
e AS (
  SELECT DISTINCT list, CASE WHEN list = 'trusted' THEN 'allow' ELSE 'block' END AS kind,
         CASE list WHEN 'domains' THEN parent WHEN 'paths' THEN host || '/' || top ELSE host END AS pattern, action,
         DATE '2024-01-01' + CAST(CASE WHEN list = 'domains' THEN ps ELSE hs END + plus AS INT) AS eff
  FROM n, a
  WHERE (list = 'hosts' AND hn % 4 = 0) OR (list = 'domains' AND pn % 8 = 1) OR (list = 'paths' AND hn % 3 = 1 AND top IS NOT NULL)
     OR (list = 'trusted' AND hn % 16 = 4)),
s AS (SELECT list, kind, pattern, eff, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(eff) OVER (PARTITION BY list, kind, pattern ORDER BY eff) AS til FROM s),
k AS (
  SELECT rid, fetched, array_to_string(string_split(host, '.')[x:], '.') ||
         CASE WHEN d = 0 THEN '' ELSE '/' || array_to_string(seg[1:d], '/') END AS key
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS x FROM p WHERE host IS NOT NULL), (VALUES (0), (1)) v(d)
  WHERE d <= len(seg)),
m AS (
  SELECT rid, list, pattern, kind FROM k JOIN i ON key = pattern AND action = 'add' AND fetched >= eff AND (til IS NULL OR fetched < til)),
b AS (
  SELECT rid, count(*) AS n_active, min(struct_pack(l := -length(pattern), b := kind <> 'allow', list := list, pattern := pattern, kind := kind)) AS best
  FROM m GROUP BY rid)
SELECT page_id, fetched, host, coalesce(n_active, 0) AS n_active, best.list AS list, best.pattern AS pattern,
       coalesce(best.kind = 'block', false) AS blocked
FROM p LEFT JOIN b USING (rid)
"""
