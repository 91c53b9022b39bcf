"""WARC round trips."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from stockledger.llm import warc as W

BIG = "<p>" + "é" * 600 + "</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
ROWS = [(1, "http://a.example/x?y#z", BIG), (2, "https://b.example", BIG), (9, "http://c.example/ü v", BIG), (3, "u", "small"), (4, None, "small"),
        (5, "http://d", None), (6, "http://d", ""), (None, "http://e", BIG), (7, "bad\r\nurl: x", "\n" * 1200), (8, "http://f", "x" * 3_000_000),
        (9, "http://c.example/ü v", BIG), (11, "http://g", "\r\n\r\n")]


def want(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        last = max((k for k, _, g in rows if (g or "").encode() == body and k is not None), default=None)
        again = len(body) >= 1000 and last is not None and (i is None or i < last)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0))
    path = W.write_archives(d, f"{tmp_path}/w", compression=compression, file_bytes=1 << 16)
    captures = W.assemble(W.read_records(spark, path)).withColumn("page_id", W.metadata_field("page-id").try_cast("long")).collect()
    assert len(captures) == len(ROWS) and len({c.record_id for c in captures}) == len(ROWS)
    ids = {c.record_id: c.page_id for c in captures}
    got = sorted(((c.page_id, c.response.payload_bytes, c.response.payload_digest, c.type, ids.get(c.refers_to)) for c in captures), key=str)
    assert got == want(ROWS)
    bodies = {c.page_id: bytes(c.response.payload) for c in captures if c.type == "response"}
    assert all(bodies[i] == (h or "").encode() for i, _, h in ROWS if i in bodies)
    assert all(c.request is not None and len(c.metadata) == 1 for c in captures)


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op6_warc(spark, str(tmp_path)).collect()), key=str) == want(ROWS)


def test_empty(spark, tmp_path):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.assemble(W.read_records(spark, W.write_archives(d, f"{tmp_path}/w"))).count() == 0


def test_foreign_archives(spark, tmp_path):
    """One gzip member per record, records in any order, a response without partners, a warcinfo record."""
    def rec(kind, rid, extra, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", rid), *extra, ("Content-Length", len(block))])
        return gzip.compress(("WARC/1.0\r\n" + head + "\r\n").encode() + block + b"\r\n\r\n")
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfe"
    (tmp_path / "a.warc.gz").write_bytes(
        rec("metadata", "<m1>", [("WARC-Concurrent-To", "<r1>")], b"via: x\r\n") + rec("warcinfo", "<i>", [], b"a: b")
        + rec("request", "<q1>", [("WARC-Concurrent-To", "<r1>")], b"GET / HTTP/1.1\r\n\r\n") + rec("response", "<r1>", [], body)
        + rec("metadata", "<m2>", [("WARC-Concurrent-To", "<r1>")], b"hops: 3") + rec("response", "<r2>", [], body))
    rows = {r.record_id: r for r in W.assemble(W.read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r1>", "<r2>"} and bytes(rows["<r1>"].response.payload) == b"\xff\xfe"
    assert len(rows["<r1>"].metadata) == 2 and rows["<r1>"].request.record_id == "<q1>" and rows["<r2>"].request is None


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """50 MB of pages in one partition: no archive holds more payload than asked for, unless it is one page."""
    d = spark.range(0, 5000, 1, 1).selectExpr("id AS page_id", "concat('http://h/', id) AS url",
                                              "concat(id, repeat('ab c', CASE WHEN id % 1000 = 0 THEN 800000 WHEN id % 50 = 0 THEN 50000 ELSE 1000 END)) AS html")
    limit = 2 << 20
    path = W.write_archives(d, f"{tmp_path}/w", compression="none", file_bytes=limit)
    held = {}
    for f in sorted(tmp_path.glob("w/*/part-*")):
        with open(f, "rb") as data:
            sizes = [len(W.http_parts(block)[1]) for headers, block in W.frames(data) if headers["warc-type"] == "response"]
        held[f] = sizes
        assert sum(sizes) <= limit or len(sizes) == 1
    assert sum(map(len, held.values())) == 5000 and sorted({f.parent.name for f in held}) == ["size-0", "size-1", "size-2"]
    captures = W.assemble(W.read_records(spark, path, payloads=False))
    assert captures.select("record_id").distinct().count() == captures.where("size(metadata) = 1 AND request IS NOT NULL").count() == 5000


def test_revisits_across_size_classes(spark, tmp_path):
    """Equal payloads share a class whatever their urls; every class keeps its revisits."""
    rows = [(i, f"http://h/{'u' * (i * 5000)}", "p" * n) for n in (2000, 20_000, 400_000) for i in range(n, n + 3)]
    rows += [(2000, "http://other/" + "v" * 30_000, "p" * 2000), (2000, "http://other/", "p" * 2000)]
    rows = [(i, u[:40_000], h) for i, u, h in rows]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = W.assemble(W.read_records(spark, W.write_archives(d, f"{tmp_path}/w")))
    captures = captures.withColumn("page_id", W.metadata_field("page-id").try_cast("long")).collect()
    ids = {c.record_id: c.page_id for c in captures}
    assert len(ids) == len(rows)
    got = sorted(((c.page_id, c.response.payload_bytes, c.response.payload_digest, c.type, ids.get(c.refers_to)) for c in captures), key=str)
    assert got == want(rows)


def test_cut_records_raise():
    with pytest.raises(ValueError):
        list(W.frames(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(W.frames(io.BytesIO(b"<html>")))
