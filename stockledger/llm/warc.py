"""Operator 6: WARC archives, written from pages and read back by transaction assembly.

Writing: every page gives a response (or revisit) record with its HTTP block, a request and a
metadata record that name it in WARC-Concurrent-To.  Of pages with equal payloads of at least
``min_bytes`` the one with the largest id is the response, the others revisit it (HTTP headers
only; digest, Content-Length and WARC-Refers-To say what was left out).  Roles are decided on
(id, digest, size) rows alone, pre-aggregated by digest; payloads move once, dealt evenly by
page.  The archives are written by Spark's text writer (so to any store Spark can write):
a record is a line, and the line separator is the blank lines that end a record.  An archive
holds payloads of at most ``file_bytes``, or one page: pages are written by size class (steps of
16 times), and a file takes as many pages as fit at the largest size of their class.  Only classes
that occur are written, each from a scan of its own; small pages are one class and one scan.

Reading: archives are taken as binary files and framed record by record by Content-Length in
the tasks (plain or gzip, also one member for each record).  ``assemble`` joins requests and
metadata to their response or revisit by concurrent-to identifiers and emits one nested row
per capture.

Cases: null html is an empty payload; a null url gives no target URI; white space and control
characters in urls are percent-encoded; null ids rank below all others and stay null; repeated
rows are captures of their own (numbered, so that identifiers differ); an empty table gives no
archives and no captures.  Only the id, url and html columns are read; others cannot clash.
A payload of any length is one record; a reading task holds one archive file and one record
(Spark's binary source raises on foreign files over 2 GB).
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockledger.llm.common import read, stored
from stockledger.session import scratch_path

MIN_BYTES = 1000
FILE_BYTES = 128 << 20         # payload bytes of one archive file with more than one page, at most
SMALL_PAGE = 16 << 10          # payload bytes of the smallest size class
VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, digest, response): the pages that revisit another, and that page's id."""
    light = pages.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    groups = light.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").drop("n")
    return (light.join(groups, "digest").where("id is null or id < response").select("id", "digest", "response").distinct())


def urn(*parts: Column) -> Column:
    """A record identifier made from its parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the blank lines that end it; headers with a null value are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF))).otherwise("") for k, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit(VERSION + CRLF), *lines, size, block)


def records_of(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """(value): three records for every row of (id, url, payload); ``revisits`` as ``roles`` gives them."""
    # one text key for page and payload: the numbering and the join share the payloads' only exchange
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("digest"))
    keyed = pages.withColumn("digest", F.sha1("payload")).withColumn("key", key)
    again = revisits.select(key.alias("key"), "response")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("url"))
    rows = keyed.withColumn("copy", copy).join(again, "key", "left")
    revisit, clean = F.col("response").isNotNull(), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    own = urn(F.lit("capture"), F.col("id"), F.col("digest"), F.col("copy"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", clean)]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    main = record(
        [("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", F.col("own")), *common,
         ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("WARC-Refers-To", F.when(revisit, urn(F.lit("capture"), F.col("response"), F.col("digest"), F.lit(1)))),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string"))))
    path = F.coalesce(F.nullif(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(clean, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    asked = record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn(F.lit("request"), F.col("own"))), *common,
         ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    about = record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn(F.lit("metadata"), F.col("own"))), *common,
         ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)))
    return rows.withColumn("own", own).select(F.explode(F.array(asked, main, about)).alias("value"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = MIN_BYTES, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> str:
    """Write every page into archives below ``path``, a folder for each size class that has pages."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    bounds = [b for b in (SMALL_PAGE << 4 * i for i in range(16)) if b < file_bytes]
    # copies of a page have one payload size, so one class: their numbering is whole in each write
    kind = sum(((F.octet_length("payload") > b).cast("int") for b in bounds), F.lit(0))
    found = sorted(r["k"] for r in src.select(kind.alias("k")).distinct().collect())
    revisits = roles(src, min_bytes)
    if len(found) > 1:
        revisits = stored(revisits, "revisits")
    for k in found or [0]:
        mine = src.where(kind == k) if len(found) > 1 else src
        pages_a_file = file_bytes // bounds[k] if k < len(bounds) else 1
        (records_of(mine, revisits).write.option("lineSep", CRLF + CRLF).option("compression", compression)
         .option("maxRecordsPerFile", 3 * pages_a_file).text(f"{path}/size-{k}"))
    return path


def frames(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; raises on anything that is not a whole record."""
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = data.read(size)
        if len(block) < size:
            raise ValueError(f"cut record {headers.get('warc-record-id')}")
        yield headers, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, body


_RECORD = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                     ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_DDL = ("type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
        "payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def parsed(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A record's row: for responses size and SHA-1 of the payload, for revisits what the record says of it."""
    kind = headers.get("warc-type")
    size = digest = body = None
    fields: dict[str, str] = {}
    if kind in ("response", "revisit", "request"):
        fields, body = http_parts(block)
    if kind == "response":
        size, digest = len(body), hashlib.sha1(body).hexdigest()
    elif kind == "revisit":
        size = int(fields.get("content-length", 0))
        digest = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    elif kind == "metadata":
        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
    return (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), size, digest, list(fields.items()), body if payloads else None)


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row for every record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)

        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                data = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                rows, held = [], 0
                for headers, block in frames(io.BufferedReader(data) if data is not raw else raw):
                    rows.append(parsed(headers, block, payloads))
                    held += len(block)
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records."""
    main = records.where("type in ('response', 'revisit')")
    part = records.where("concurrent_to is not null")
    asked = part.where("type = 'request'").groupBy(F.col("concurrent_to").alias("asked_of")).agg(
        F.min(F.struct("record_id", "target_uri", "date")).alias("request"))
    about = (part.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("about_of")).agg(F.sort_array(F.collect_list(F.struct(
        "record_id", F.map_entries("fields").alias("fields")))).alias("metadata")))
    return (main.join(asked, F.col("record_id") == F.col("asked_of"), "left")
            .join(about, F.col("record_id") == F.col("about_of"), "left")
            .select("record_id", "type", "target_uri", "date", "refers_to",
                    F.struct("payload_bytes", "payload_digest", "fields", "payload").alias("response"), "request", "metadata"))


def metadata_field(name: str) -> Column:
    """The first value of a field in a capture's metadata records."""
    entries = F.filter(F.flatten("metadata.fields"), lambda e: e["key"] == name)
    return F.get(entries, 0)["value"]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back and list the captures."""
    path = write_archives(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    captures = stored(assemble(stored(read_records(spark, path, payloads=False), "records")).select(
        metadata_field("page-id").try_cast("long").alias("page_id"), "record_id", "type", "refers_to",
        "response.payload_bytes", "response.payload_digest"), "captures")
    # a response's identifier is unique; many revisits may name it, and AQE splits those
    known = captures.where("type = 'response'").select(F.col("record_id").alias("rid"), F.col("page_id").alias("refers_page"))
    return captures.join(known, captures["refers_to"] == known["rid"], "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(octet_length(encode(html)), 0) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p),
r AS (SELECT *, n >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM r
"""
